"""Text as columns. White space and word characters are Unicode's, written out where the regex engine's differ."""

from __future__ import annotations

from collections.abc import Iterator
from unicodedata import normalize

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import SECOND, DedupConfig
from .numbers import div

#: White space as Unicode and the four ASCII separators have it. The first 256 characters are listed one by one: the regex
#: engine looks such up in a table, but tries classes and ranges one after the other.
SPACE = r"[ \t\n\x0B\f\r\x1C\x1D\x1E\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: Runs of anything else; they never give back what they took.
WORD = f"[^{SPACE[1:-1]}]++"

# Marks and cases that a punctuation model's labels are made of.
MARKS = {
    "O": "", "PERIOD": ".", "COMMA": ",", "QUESTION": "?", "TIRE": "—", "DVOETOCHIE": ":", "VOSKL": "!",
    "PERIODCOMMA": ";", "DEFIS": "-", "MNOGOTOCHIE": "...", "QUESTIONVOSKL": "?!",
}
CASES = ("LOWER", "UPPER", "UPPER_TOTAL")


#: All white space characters, for trimming without a regular expression.
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def squeeze(text: Column) -> Column:
    """Words joined by one blank."""
    return F.trim(F.regexp_replace(text, f"{SPACE}++", " "))


def words(text: Column) -> Column:
    """Split at blanks once runs of white space are one: a match for each word takes ten times as long."""
    return F.array_remove(F.split(squeeze(text), " "), "")


def word_count(text: Column) -> Column:
    """Number of ``words``, without making them."""
    return F.regexp_count(text, F.lit(WORD))


def is_dense(text: Column, duration_us: Column, config: DedupConfig = DedupConfig()) -> Column:
    """At least so many words or so many characters a second; no text is never dense. A length of zero counts as 1 ns."""
    us = F.greatest(duration_us.cast("double"), F.lit(0.001))
    dense = (word_count(text) * float(SECOND) >= us * config.min_words_per_s) | (F.length(text) * float(SECOND) >= us * config.min_chars_per_s)
    return F.coalesce((F.length(text) > 0) & dense, F.lit(False))


def in_parts(texts: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Start and length of runs of ``texts`` of at most so many bytes, or of one text: a batch is bounded by its rows only."""
    start = size = 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if k > start and size + n > most:
            yield start, k - start
            start, size = k, 0
        size += n
    if start < len(texts):
        yield start, len(texts) - start


def nfkc(text: Column) -> Column:
    """Compatibility form, in Arrow batches; Spark has no function for it."""

    @F.arrow_udf("string")
    def normalised(column: pa.Array) -> pa.Array:
        parts = [pa.array([t and normalize("NFKC", t) for t in column.slice(a, n).to_pylist()], pa.string()) for a, n in in_parts(column)]
        return pa.concat_arrays([*parts, pa.array([], pa.string())])

    return normalised(text)


#: Texts of these characters alone are their own compatibility form: no combining marks, and none with a compatible spelling.
#: ASCII, Latin, Cyrillic, common punctuation, kana and unified ideographs.
STABLE = (
    r"^[\x00-\x7F\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E"
    r"\u0400-\u0482\u048A-\u04FF\u2010\u2012-\u2016\u2018-\u2023\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FFF]*+$"
)


def norm_text(text: Column) -> Column:
    """Lower-cased words without punctuation, in compatibility form, joined by one blank. Python gets only texts that may have
    another form: Spark calls it for all rows, whatever branch the call is in, so the others are sent as nulls."""
    plain = F.coalesce(nfkc(F.when(~text.rlike(STABLE), text)), text)
    return squeeze(F.lower(F.regexp_replace(plain, rf"[^\p{{L}}\p{{N}}_{SPACE[1:-1]}]++", "")))


def norm_tokens(text: Column) -> Column:
    """The words of ``norm_text``."""
    return F.array_remove(F.split(norm_text(text), " "), "")


def capitalised(token: Column) -> Column:
    """First letter in title case, the rest in lower case."""
    first = F.translate(F.upper(F.left(token, F.lit(1))), "ǄǇǊǱ", "ǅǈǋǲ")
    return F.concat(F.left(first, F.lit(1)), F.lower(F.substring(first, 2, 9)), F.lower(F.substring(token, 2, 1 << 30)))


def marked(token: Column, label: Column) -> Column:
    """A token in the case and with the mark of its label; any other label leaves it. One lookup, not a branch a label."""
    known = F.create_map(*[F.lit(x) for k, v in MARKS.items() for x in (k, v)])
    parts = F.regexp_extract(label, r"^(LOWER|UPPER_TOTAL|UPPER)_([A-Z]+)$", 1), F.regexp_extract(label, r"^(LOWER|UPPER_TOTAL|UPPER)_([A-Z]+)$", 2)
    mark = F.element_at(known, parts[1])
    shaped = F.when(parts[0] == "UPPER", capitalised(token)).when(parts[0] == "UPPER_TOTAL", F.upper(token)).otherwise(token)
    glue = F.when((parts[1] == "TIRE") & (parts[0] != "LOWER"), F.lit(" ")).otherwise(F.lit(""))
    return F.when(mark.isNull(), token).otherwise(F.concat(shaped, glue, mark))


def fix_spaces(text: Column) -> Column:
    """No blank before marks, one on each side of a dash that has one before it, no double blanks. Runs are squeezed first, by a
    match that never backs up, so what follows looks at single characters: linear in any text."""
    out = F.regexp_replace(strip(text), f"{SPACE}{{2,}}+", " ")
    out = F.regexp_replace(out, f"{SPACE}([,.;:!?…])", "$1")
    return strip(F.regexp_replace(out, f"{SPACE}—{SPACE}?", " — "))


def split_index(text: Column) -> Column:
    """Where to split a long text: its last white space before the middle, else the first behind it, else -1."""
    middle = div(F.length(text), 2).cast("int")
    before = F.regexp_instr(F.reverse(F.left(text, middle)), F.lit(SPACE))
    behind = F.regexp_instr(F.substr(text, middle + 1), F.lit(SPACE))
    return F.when(F.length(text) < 2, -1).when(before > 0, middle - before).when(behind > 0, middle + behind - 1).otherwise(-1).cast("int")


def token_count(text: Column) -> Column:
    """Tokens as a quarter of the characters, at least one."""
    return F.greatest(F.lit(1), div(F.length(text) + 3, 4)).cast("long")


def token_count_of_parts(text: Column) -> Column:
    """Aggregate: tokens of all texts of a group, characters added up first."""
    return F.greatest(F.lit(1), div(F.coalesce(F.sum(F.length(text)), F.lit(0)) + 3, 4)).cast("long")


def chunk_count(total: Column, target: int, most: int) -> Column:
    """Chunks of about ``target`` tokens none of which has more than ``most`` on average, but no more than tokens."""
    up = lambda d: div(total + (d - 1), d)
    first = F.greatest(F.lit(1), up(max(1, target)))
    return F.greatest(first, F.least(up(max(1, most)), total)).cast("int")


def recognised(raw: Column) -> Column:
    """Text of a recogniser's JSON answer: an object's first non-empty of transcription, text and transcript; a list's items
    joined by blanks; else the answer itself."""
    pick = lambda o: F.coalesce(*[F.nullif(F.get_json_object(o, f"$.{k}"), F.lit("")) for k in ("transcription", "text", "transcript")])
    items = F.from_json(raw, "array<string>")
    joined = F.trim(F.array_join(F.transform(items, lambda i: F.coalesce(F.when(i.startswith("{"), pick(i)), i)), " "))
    return F.when(raw.rlike(r"^\s*\{"), F.coalesce(pick(raw), F.lit(""))).when(raw.rlike(r"^\s*\["), joined).otherwise(raw)


def quoted(text: Column) -> Column:
    """``text`` as a JSON string."""
    return F.substring(F.to_json(F.struct(text.alias("x"))), 6, 1 << 30).substr(F.lit(1), F.length(F.to_json(F.struct(text.alias("x")))) - 6)
