"""The labelled table that the extraction tree is trained on: pages written and labelled by hand.

A block that belongs to the article begins with ``¶``; all others are boilerplate. The pages differ in language, markup
and habits: semantic elements, telling, misleading and meaningless class names, tables as layout, notices, adverts and comments.
"""

PAGES = (
    # a newspaper in semantic markup
    """<header><a href="/">The Harbour Post</a><p>Local news since 1921</p></header>
<nav><ul><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li><li><a href="/c">Culture</a></li><li><a href="/j">Jobs</a></li></ul></nav>
<main><article><h1>¶Ferry line to the islands will run all winter</h1>
<p>¶The council agreed on Tuesday to pay for a daily ferry between the old harbour and the three islands from November to March, ending a dispute that has lasted for six years.</p>
<p>¶Until now the last boat left in the middle of October. Families on the islands had to <a href="/x">book a cargo plane</a> or wait for calm weather and a neighbour with a boat.</p>
<h2>¶Who pays</h2>
<p>¶Half of the money comes from the regional fund, the rest from a small charge on summer tickets.</p>
<p>¶"We waited long enough," said the mayor.</p>
<aside><h3>More on this</h3><p><a href="/1">Ten years of the island bridge debate</a></p><p><a href="/2">What a ticket costs</a></p></aside>
<p>¶The first winter boat is to leave on the second of November at seven in the morning.</p></article>
<section id="comments"><h2>3 comments</h2><div>Anna M. <span>2 hours ago</span></div><p>Finally some good news. I have been asking for this since my daughter started school on the mainland.</p><div>Pete</div><p>And who will clear the ice from the pier? Nobody thought about that, as usual.</p><p><a href="/r">Reply</a></p></section></main>
<aside><h3>Most read</h3><ul><li><a href="/a">Storm takes the roof off the market hall</a></li><li><a href="/b">Two new bakeries for the old town</a></li></ul></aside>
<footer><p>© The Harbour Post. All rights reserved.</p><a href="/i">Imprint</a> <a href="/p">Privacy</a></footer>""",
    # a blog in plain divisions with telling names
    """<div id="masthead"><div class="logo"><a href="/">slow bread</a></div><div class="tagline">notes from a small kitchen</div></div>
<div class="navbar"><a href="/">Home</a> <a href="/about">About</a> <a href="/recipes">Recipes</a></div>
<div class="cookie-notice"><p>We use cookies to understand how this site is used. You can read more about it in our policy or switch them off.</p><button>Accept</button></div>
<div class="post"><div class="title">¶Why I stopped kneading</div>
<div class="text">¶For years I believed that good dough needs strong arms. Then I forgot a bowl of flour and water on the stove overnight.</div>
<div class="text">¶In the morning it was smooth and full of air, as if somebody had worked it for half an hour.</div>
<ul><li>¶500 g of flour</li><li>¶380 g of water</li><li>¶10 g of salt</li><li>¶a spoon of yesterday's dough</li></ul>
<div class="text">¶Mix it all, cover it, go to bed.</div></div>
<div class="share">Share this: <a href="#">mail</a> <a href="#">print</a></div>
<div class="comment-list"><div class="comment"><b>Lena</b><p>I tried this with rye and it works just as well, only the crust needs more heat at the beginning.</p></div><div class="comment"><b>tom_77</b><p>Twelve hours is too long in my kitchen, it gets sour.</p></div></div>
<form class="signup"><p>Get a letter from my kitchen once a month, no advertising, promised.</p><label>Your address</label><input><button>Sign up</button></form>
<div class="footer">made by hand · <a href="/feed">feed</a></div>""",
    # meaningless names from a style compiler
    """<div class="css-1x9"><div class="css-ab2"><a href="/">Start</a></div><div class="css-ab2"><a href="/m">Magazin</a></div><div class="css-ab2"><a href="/k">Kontakt</a></div></div>
<div class="css-77q"><div class="css-t1">¶Wie der Wald nach dem Feuer zurückkommt</div>
<div class="css-p0">¶Drei Jahre nach dem Brand stehen am Südhang schon wieder Birken, die einem Kind bis zur Schulter reichen. Niemand hat sie gepflanzt.</div>
<div class="css-p0">¶Der Wind trug die Samen vom Nachbartal herüber, und die Asche gab ihnen den ersten Sommer lang alles, was sie brauchten.</div>
<div class="css-im">Foto: privat</div>
<div class="css-p0">¶Förster wie Karl Brandt sehen das mit gemischten Gefühlen. Sie hätten gern mehr Eichen, doch Eichen brauchen Zeit und jemanden, der die Rehe fernhält.</div>
<div class="css-p0">¶„Der Wald hat es nicht eilig“, sagt er.</div></div>
<div class="css-9zz"><div class="css-l"><a href="/1">Der Fluss, der rückwärts fließt</a></div><div class="css-l"><a href="/2">Besuch bei der letzten Köhlerin</a></div><div class="css-l"><a href="/3">Was Ameisen über Straßen wissen</a></div></div>
<div class="css-f0"><div>© Waldmagazin</div><div><a href="/i">Impressum</a></div><div><a href="/d">Datenschutz</a></div></div>""",
    # names that mislead: the article stands in elements named after side parts
    """<nav><a href="/">Inicio</a> <a href="/t">Temas</a> <a href="/b">Buscar</a></nav>
<div class="related-story"><h1>¶El faro que nadie quería</h1>
<p>¶Durante cuarenta años el faro de Punta Arena no tuvo dueño. El ministerio decía que era del puerto, y el puerto que era del ministerio.</p>
<p>¶Mientras tanto la familia Ortega encendía la luz todas las tardes, primero con aceite, luego con una lámpara comprada por los pescadores.</p>
<p>¶Hoy es un pequeño museo con tres habitaciones y una terraza desde la que se ve la costa entera.</p></div>
<div class="box promo"><p>Suscríbase por dos euros al mes y lea todos los artículos sin límite.</p></div>
<footer><p>Redacción · <a href="/a">Aviso legal</a> · <a href="/c">Contacto</a></p></footer>""",
    """<div class="header"><a href="/">Consumer Notes</a></div>
<div class="menu"><ul><li><a href="/1">Money</a></li><li><a href="/2">Home</a></li><li><a href="/3">Travel</a></li></ul></div>
<div id="text-ads-free" class="entry share"><h1>¶What a fair cookie banner looks like</h1>
<p>¶A fair banner asks one question, offers two buttons of the same size, and goes away for good once it has an answer. Few banners do all three.</p>
<p>¶We looked at two hundred shops. In more than half of them the button that says no was grey, small, or hidden behind a second page.</p>
<h3>¶What the law says</h3><p>¶Consent must be as easy to refuse as to give. That sentence has been in force for years, yet it is rarely enforced.</p>
<p>¶Shops that changed their banner lost almost no visitors.</p></div>
<div class="widget"><h4>Newsletter</h4><p>One mail a week with our best tests.</p><input><button>Subscribe</button></div>
<div class="footer">Consumer Notes, a registered association. <a href="/i">Imprint</a></div>""",
    # tables as layout
    """<table><tr><td colspan="2"><a href="/">Home</a> | <a href="/faq">FAQ</a> | <a href="/links">Links</a> | <a href="/guest">Guestbook</a></td></tr>
<tr><td><b>Pages</b><br><a href="/1">Radios</a><br><a href="/2">Tubes</a><br><a href="/3">Schematics</a></td>
<td><h2>¶Restoring a 1938 receiver</h2><p>¶Before you plug anything in, replace the paper capacitors. They look fine and they are not: after eighty years nearly all of them leak.</p>
<p>¶Next, clean the chassis with a soft brush. Never use water, and keep spirit away from the printed dial, which comes off at once.</p>
<p>¶Bring the voltage up slowly over an hour and watch the current.</p>
<table><tr><td>¶Heater</td><td>¶6.3 V</td></tr><tr><td>¶Plate</td><td>¶250 V</td></tr></table>
<p>¶If the dial lamp glows and nothing smells, you are nearly done.</p></td></tr>
<tr><td colspan="2">Last change: May 2003. <a href="mailto:x">Write to me</a></td></tr></table>""",
    # a short notice of a town, comments long and many
    """<div class="wrapper has-sidebar"><div class="topbar"><a href="/l">Log in</a> <a href="/r">Register</a></div>
<article class="story"><h1>¶Pool closed until Friday</h1><p>¶The indoor pool stays closed until Friday because a pump has to be replaced. Season tickets are extended by a week.</p></article>
<div class="discussion"><h3>Discussion</h3>
<div class="reply"><i>swimmer</i><p>This is the third time this year. Last spring the heating failed, then the roof leaked, now the pump. Could somebody explain where the money for repairs goes, because it certainly does not go into repairs?</p></div>
<div class="reply"><i>M. Okafor</i><p>The pump was bought used. I was at the meeting when they decided it, and several of us warned them that it would not last for two seasons.</p></div>
<div class="reply"><i>Guest</i><p>The lake is free and open.</p></div></div>
<div class="sidebar"><h3>Opening hours</h3><p>Monday to Friday from nine to five, closed on public holidays and during the summer break in August.</p></div></div>
<div class="copyright">© Town of Hollerbach</div>""",
    # French, semantic and telling, with adverts inside the article
    """<header class="site-header"><a href="/">Le Carnet</a></header><nav class="menu"><a href="/a">Actualités</a><a href="/v">Voyages</a><a href="/g">Goûts</a></nav>
<div role="dialog" class="gdpr"><p>Nous et nos partenaires utilisons des traceurs pour mesurer l'audience. Vous pouvez accepter, refuser ou choisir.</p><button>Tout accepter</button><button>Refuser</button></div>
<article><h1>¶Une semaine sans voiture à travers les Cévennes</h1><p>¶Le premier matin, le car de sept heures était vide. Le chauffeur m'a proposé de choisir la musique, et nous avons roulé jusqu'au col en écoutant Barbara.</p>
<div class="ad"><p>Louez une voiture dès neuf euros par jour, annulation gratuite jusqu'à la veille.</p><a href="/pub">J'en profite</a></div>
<p>¶À Florac, tout se fait à pied. Le marché tient sur une place, la rivière passe derrière, et l'on trouve encore un cordonnier.</p>
<blockquote>¶On ne traverse pas les Cévennes, on s'y arrête.</blockquote>
<p>¶Le retour s'est fait en train, par la ligne que l'on voulait fermer.</p>
<footer>Classé dans <a href="/t/1">voyages</a>, <a href="/t/2">train</a></footer></article>
<div class="newsletter"><p>Recevez nos carnets chaque dimanche dans votre boîte.</p><input><button>S'inscrire</button></div>
<aside><h2>À lire aussi</h2><a href="/1">Le gîte au bout du chemin</a><a href="/2">Trois jours sur le causse</a></aside><footer>© Le Carnet — <a href="/m">Mentions légales</a></footer>""",
    # documentation: many short blocks, lists and links belong to the text
    """<div id="top"><a href="/">project</a> <a href="/docs">docs</a> <a href="/blog">blog</a> <a href="/code">code</a></div>
<div id="side-navigation" class="navigation"><ul><li><a href="/1">Install</a></li><li><a href="/2">First steps</a></li><li><a href="/3">Settings</a></li><li><a href="/4">Questions</a></li></ul></div>
<div id="content" class="main"><h1>¶Settings</h1><p>¶Settings live in one file.</p><h2>¶Where it is found</h2><p>¶The program looks in these places, the first one wins:</p>
<ol><li>¶the file named on the command line</li><li>¶<a href="/e">the environment</a></li><li>¶the home folder</li></ol>
<h2>¶Keys</h2><p>¶<b>timeout</b></p><p>¶Seconds to wait for an answer. See also <a href="/r">retries</a> and <a href="/b">back-off</a>.</p><pre>¶timeout = 30
retries = 3</pre><p>¶Unknown keys are an error.</p></div>
<div class="pager"><a href="/p">Previous: First steps</a> <a href="/n">Next: Questions</a></div><div id="footer">Built with care. <a href="/edit">Edit this page</a></div>""",
    # opaque names with a notice and comments that only their place and surroundings tell
    """<div class="a1"><a href="/">Nordlicht</a><a href="/x">Themen</a><a href="/y">Podcast</a><a href="/z">Abo</a></div>
<div class="q9"><div>Diese Seite verwendet Cookies, um Inhalte anzupassen und Zugriffe zu messen. Einzelheiten stehen in der Erklärung.</div><button>Einverstanden</button><button>Ablehnen</button></div>
<div class="k4"><h1>¶Die Insel, die jedes Jahr umzieht</h1><p>¶Wer die Karte von 1890 neben die von heute legt, glaubt an einen Druckfehler. Die Insel liegt zwei Kilometer weiter östlich.</p>
<p>¶Strömung und Wind nehmen am einen Ende den Sand fort und legen ihn am anderen wieder ab. Häuser, die mitten im Ort standen, stehen eine Generation später am Strand.</p>
<p>¶Die Leute haben sich darauf eingerichtet. Sie bauen auf Pfählen und streiten über Grenzen, die längst im Wasser liegen.</p></div>
<div class="m2"><div>Teilen</div><div><a href="#">Mail</a></div><div><a href="#">Drucken</a></div></div>
<div class="r7"><div>Was meinen Sie?</div><div>Jürgen</div><div>vor 3 Stunden</div><div>Mein Großvater hat dort noch Kühe gehalten.</div><div>Antworten</div><div>Inselkind</div><div>gestern</div><div>Zwei Kilometer sind übertrieben.</div><div>Antworten</div><textarea>x</textarea><button>Absenden</button></div>
<div class="z0">© Nordlicht Verlag <a href="/i">Impressum</a> <a href="/d">Datenschutz</a></div>""",
    # a shop's product page
    """<header><div class="search"><input><button>Find</button></div><a href="/cart">Cart (0)</a></header><nav><a href="/1">Tents</a><a href="/2">Stoves</a><a href="/3">Lamps</a></nav>
<div class="breadcrumb"><a href="/">Home</a> &gt; <a href="/2">Stoves</a> &gt; Ember 2</div>
<section class="body"><h1>¶Ember 2 wood stove</h1><p>¶Folds flat, weighs less than a litre of water and burns whatever lies on the ground. The second version has a stronger grate.</p>
<ul><li>¶Steel, 740 g</li><li>¶Boils a litre in nine minutes</li><li>¶Made in Slovenia</li></ul><p>¶Let it cool before you pack it.</p></section>
<div class="promo"><h3>You may also like</h3><div><a href="/a">Windshield</a></div><div><a href="/b">Folding saw</a></div></div>
<div class="reviews comments"><h3>Reviews</h3><p>Very good, though the bag tore after a month and I had to sew a new one out of an old pair of trousers.</p><p>Smokes a lot when the wood is damp.</p></div>
<form><p>Tell us what you think of this page, it takes a minute and helps us a lot.</p><textarea>x</textarea><button>Send</button></form><footer><ul><li><a href="/s">Shipping</a></li><li><a href="/r">Returns</a></li></ul><p>Ember Outdoor d.o.o., Ljubljana</p></footer>""",
    # an essay without any other parts
    """<h1>¶On walking slowly</h1><p>¶There is a speed at which a street stops being a way to somewhere and becomes a place.</p><p>¶It is lower than most people think. I have measured it, in the only way such things can be measured, by walking the same street every day for a month, a little slower each time, until the shopkeepers began to greet me.</p><p>¶They took me for an inspector.</p><p>¶By the third week they had told me about their knees, their sons, the rent.</p>""",
    # a forum thread opened by the article-like first post, long link lists before it
    """<div class="toolbar"><a href="/1">Forum</a><a href="/2">Members</a><a href="/3">Search</a></div>
<div class="links"><div><a href="/11">Which oil for an old saw chain</a></div><div><a href="/12">Sharpening by hand, step by step</a></div><div><a href="/13">Found a wasp nest in the shed</a></div></div>
<div class="notice"><p>Notice: the forum moves to a new server on Sunday evening and cannot be reached for about two hours.</p></div>
<div class="entry"><h2>¶How I season oak for tool handles</h2><p>¶Split it the day it is felled, while the rings still part willingly. Paint the ends with anything that keeps the water in, old wall paint is good enough.</p><p>¶Then stack it under a roof with a finger's width of air around every piece, and forget it for two years. A thumb of thickness takes a year, roughly.</p><p>¶Handles made from it outlive the heads.</p></div>
<div class="advert sponsored"><p>Chains, bars and files at half the price, delivered tomorrow.</p></div>
<div class="footer"><a href="/rules">Rules</a> <a href="/mods">Moderators</a></div>""",
    # a news page whose footer and side column are long prose
    """<div id="nav"><ul><li><a href="/p">Portada</a></li><li><a href="/m">Mundo</a></li><li><a href="/e">Economía</a></li></ul></div>
<div id="main"><h1>¶La cosecha llega un mes antes</h1><p>¶En el valle se vendimia ya a comienzos de agosto. Los agricultores hablan del año más temprano desde que hay registros, y no todos están contentos.</p><p>¶La uva tiene azúcar, pero le falta acidez, explica Marta Ruiz, que dirige la cooperativa.</p><p>¶Algunos han empezado a plantar más arriba.</p></div>
<div id="sidebar"><h3>Quiénes somos</h3><p>Somos un periódico pequeño, sin accionistas ni deudas, que vive de sus lectores y que publica cada día lo que ocurre en la comarca.</p></div>
<div class="disclaimer"><p>Los textos de esta página pueden citarse mencionando la fuente. Las opiniones de los autores no son necesariamente las de la redacción.</p></div>
<div role="contentinfo"><p>Editado en papel reciclado. Depósito legal 12-1987.</p></div>""",
    # divisions without any names between two menus
    """<div><div><a href="/1">Start</a></div><div><a href="/2">Verein</a></div><div><a href="/3">Termine</a></div><div><a href="/4">Bilder</a></div></div>
<div>¶Der Chor fährt im Mai für eine Woche nach Olmütz und singt dort drei Konzerte, eines davon im Dom.</div><div>¶Wer mitwill, meldet sich bis Ende Januar.</div><div>¶Geprobt wird wie immer am Donnerstag, ab März auch an zwei Samstagen. Die Noten liegen im Schrank neben der Tür, bitte nur mit Bleistift hineinschreiben.</div>
<div><div><a href="/5">Impressum</a></div><div><a href="/6">Anfahrt</a></div><div><a href="/7">Förderer</a></div></div>""",
    """<div><a href="/a">Latest</a> <a href="/b">Archive</a> <a href="/c">Tags</a> <a href="/d">Search</a></div><div>¶The bridge opens</div><div>¶After nine years of work, two bankruptcies and one flood the new bridge over the Lenne opens on Saturday at noon.</div>
<div>¶Cars may use it from Monday on.</div><div>¶Until then it belongs to people on foot, and the fire brigade will hang a swing from the middle arch for everybody who dares.</div><div>¶Bring a coat.</div>
<div><div><a href="/1">The bridge that was never paid for</a></div><div><a href="/2">How a flood is measured</a></div><div><a href="/3">Nine photographs</a></div></div><div>Printed at night. <a href="/i">Imprint</a></div>""",
    """<ul><li><a href="/1">Portada</a></li><li><a href="/2">Cartas</a></li></ul><p>¶Querida Ana:</p><p>¶llegamos ayer, de noche y con lluvia, y todavía no hemos visto el mar, aunque se oye desde la cama.</p><p>¶La casa es pequeña.</p>
<p>¶Tu hermano ha encontrado un gato o el gato lo ha encontrado a él, no está claro, y ahora duerme en la maleta abierta.</p><p>¶Escribe.</p><p>¶Luis</p><p><a href="/ant">Carta anterior</a> <a href="/sig">Carta siguiente</a></p>""",
    # hardly more than a text
    """<article><p>¶Nobody answered the door, so we left the parcel with the baker, who promised to keep it away from the oven until you are back.</p></article>""",
    """<div>¶Die Sitzung am Montag fällt aus. Die nächste findet am zwölften statt, wieder um acht, wieder im kleinen Saal, und wer kann, bringt einen Stuhl mit.</div>""",
    """<article>¶Gone fishing. <i>The shop opens again when the river is too high or the fish have won, whichever comes first.</i></article>""",
    """<h2>¶Aviso</h2><p>¶El camino viejo está cortado por un desprendimiento. Se puede pasar a pie por la era, con cuidado.</p>""",
)
