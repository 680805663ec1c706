import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from turnweave.model import PlanConfig
from turnweave.summary import clients, fold, messages, policy
from turnweave.summary.clients import DIALECTS, DryRun, HttpChat
from turnweave.summary.policy import ChatError, RateLimited, RateLimiter, Retry

ASK = [{"role": "system", "content": [{"type": "text", "text": "be brief"}]}, {"role": "assistant", "content": "before"}, {"role": "user", "content": [{"type": "text", "text": "l1"}, {"text": " "}, {"text": "l2\nl3"}]}]


class Network:
    """Answers in turn; remembers what was asked and slept."""

    def __init__(self, *answers):
        self.answers, self.asked, self.slept = list(answers), [], []

    def send(self, url, headers, body, timeout):
        self.asked.append((url, headers, json.loads(body)))
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        status, found = answer[:2]
        return status, answer[2] if len(answer) > 2 else {}, found if isinstance(found, str) else json.dumps(found)

    def client(self, name, **options):
        return HttpChat(DIALECTS[name], "m", "key", send=self.send, sleep=self.slept.append, **options)


def candidates(*texts):
    return {"candidates": [{"content": {"parts": [{"text": t} for t in texts]}}]}


def choices(content):
    return {"choices": [{"message": {"content": content}}]}


def test_dry_run():
    assert DryRun().chat([{"role": "user", "content": "l1\nl2"}]) == "[dry-run] l2"
    assert DryRun().chat(ASK) == "[dry-run] l3"
    assert DryRun().chat([{"role": "assistant", "content": "x"}]) == "[dry-run]"
    assert DryRun().chat([{"role": "user", "content": "x" * 200}]) == "[dry-run] " + "x" * 120


def test_contents():
    assert messages.plain([{"text": " a "}, {"text": ""}, "z", {"text": "b"}]) == "a\nb"
    assert messages.plain({"text": " x "}) == "x" and messages.plain(None) == "" and messages.plain(5) == ""
    assert messages.prepared([{"role": "Robot", "content": " a "}]) == [{"role": "user", "content": "a"}]
    payload = messages.with_instruction(ASK)
    assert payload["systemInstruction"] == {"parts": [{"text": "be brief"}]}
    assert [c["role"] for c in payload["contents"]] == ["model", "user"]
    assert messages.with_instruction([])["contents"] == [{"role": "user", "parts": [{"text": ""}]}]
    assert messages.first_candidate({"candidates": [{"content": {"parts": [{"text": "t", "thought": True}]}}, {"content": [{"text": "u"}]}]}) == "u"
    assert messages.first_choice(choices([{"text": "a"}, {"text": "b"}])) == "a\nb" and messages.first_choice({}) == ""


@pytest.mark.parametrize("name, good", [("gemini", candidates("fine")), ("openrouter", choices(" fine "))])
def test_retries(name, good):
    net = Network(OSError("down"), (500, "oops"), (200, good))
    assert net.client(name).chat(ASK) == "fine"
    assert len(net.slept) == 2 and all(s <= 30 for s in net.slept)
    assert "key" not in net.asked[0][0]
    net = Network((503, "busy"), (503, "busy"), (503, "busy"))
    with pytest.raises(ChatError, match="503"):
        net.client(name).chat(ASK)
    assert net.slept == [60, 180, 300]
    for bad in ((400, {"error": {"message": "bad"}}), (200, "no json"), (200, {}), (200, candidates(" "))):
        net = Network(bad, bad, bad)
        with pytest.raises(ChatError):
            net.client(name).chat(ASK)
        assert len(net.asked) == 3 and len(net.slept) == 2


def test_rate_limits():
    net = Network((429, "slow"), (200, candidates("ok")))
    assert net.client("gemini").chat(ASK) == "ok"
    net = Network((429, {"error": {"message": "stop"}}, {"Retry-After": "7"}))
    with pytest.raises(RateLimited, match="stop") as e:
        net.client("openrouter").chat(ASK)
    assert (e.value.attempts, e.value.retry_after, net.slept) == (1, 7.0, [])
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    limiter = RateLimiter(2, clock=lambda: now[0], sleep=sleep)
    for _ in range(5):
        limiter.wait()
        now[0] += 1
    assert len(slept) == 2 and abs(sum(slept) - 116) < 5
    with pytest.raises(ChatError, match="key"):
        HttpChat(DIALECTS["gemini"], "m", "").chat(ASK)
    assert isinstance(clients.build("gemini", "x", None, dry_run=True), DryRun)
    assert clients.build("gemini", "a-flash", "k").limiter.per_minute == 5 and clients.build("openrouter", "x", "k").limiter.per_minute == 0


def test_clients_of_two_dialogs_share_the_limit(monkeypatch):
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    build = lambda: clients.build("gemini", "a-flash-for-this-test", "k", send=Network(*[(200, candidates("ok"))] * 4).send, sleep=lambda s: None)
    one, two = build(), build()  # a worker makes a client for each dialog
    assert one.limiter is two.limiter
    monkeypatch.setattr(one.limiter, "clock", lambda: now[0])
    monkeypatch.setattr(one.limiter, "sleep", sleep)
    for client in (one, two, one, two, one):
        client.chat(ASK)
    assert not slept  # five a minute
    two.chat(ASK)
    assert sum(slept) >= 60 and clients.build("gemini", "another", "k").limiter is not one.limiter


def test_digest_tells_prompts_apart():
    ask = lambda m: clients.Digest().chat(m)
    assert ask(ASK) == ask(list(ASK)) != ask(ASK[1:]) and ask(ASK) != ask([ASK[1], ASK[0], ASK[2]])


def test_policies():
    assert [Retry(base=2).delay(k, lambda a, b: 0.0) for k in (0, 1, 2, 3, 9)] == [2, 2, 4, 8, 30]
    assert Retry(base=2).delay(4, lambda a, b: b) == 18
    noon = datetime(2026, 1, 1, 12, tzinfo=UTC)
    assert policy.retry_after({"retry-after": "3"}) == 3 and policy.retry_after({}) is None and policy.retry_after({"Retry-After": "soon"}) is None
    assert policy.retry_after({"RateLimit-Reset": "Thu, 01 Jan 2026 12:00:30 GMT"}, noon) == 30
    assert policy.retry_after({"Retry-After": "Thu, 01 Jan 2026 11:00:00 GMT"}, noon) == 0
    assert policy.retry_after({"X-RateLimit-Reset": "9", "Retry-After": ""}) == 9 and policy.retry_after({"Retry-After": "-5"}) is None
    assert policy.retry_after({"Retry-After": "Thu, 01 Jan 2026 13:00:20 +0100"}, noon) == 20
    assert policy.error_message('{"error":{"message":"","code":"c"}}') == "c" and policy.error_message('{"error":{"code":4},"message":" m "}') == "m" and policy.error_message("[1]") == "[1]"
    assert policy.error_message('{"error":"x"}') == "x" and policy.error_message("<p>") == "<p>" and policy.error_message('{"message":"m"}') == "m"
    assert policy.thinking("off") == {"thinkingBudget": 0} and policy.thinking("dynamic", include=True) == {"thinkingBudget": -1, "includeThoughts": True}
    assert policy.thinking() is None and policy.thinking("default", 5) == {"thinkingBudget": 5} and policy.thinking("manual", "9") == {"thinkingBudget": 9}
    for mode, budget in (("fixed", None), ("fixed", 0), ("default", -2), ("odd", None), ("default", True), ("default", "x")):
        with pytest.raises(ValueError):
            policy.thinking(mode, budget)
    assert policy.generation(0.5, 0) == {"temperature": 0.5}


def dialogs(spark):
    rows = [(d, i + 1, "AB"[i % 2], f"{d} says {i}") for d in ("p", "q") for i in range(8)]
    return spark.createDataFrame(rows, "dialog string, index int, speaker string, text string")


def _scribe():
    class Scribe:
        """Answers with how long its prompt's last summary was; fails or stops at given calls."""

        def __init__(self, at=None, error=None, blank=()):
            self.calls, self.at, self.error, self.blank = 0, at, error, blank

        def chat(self, said):
            self.calls += 1
            if self.calls == self.at:
                raise self.error
            before = messages.plain(said[0]["content"]) if said[0]["role"] == "assistant" else ""
            return " " if self.calls in self.blank else f"{before}+{self.calls}"

    return Scribe


Scribe = _scribe()  # made in a function, it is sent to the workers as it is
WINDOWS = PlanConfig(target_tokens=6, max_tokens=8, overlap=0)


def test_summaries_window_by_window(spark):
    windows = fold.prompts_of(dialogs(spark), ["dialog"], WINDOWS)
    counts = {(r.dialog, r["pass"]): r["count"] for r in windows.groupBy("dialog", "pass").count().collect()}
    assert counts == {("p", 0): 3, ("p", 1): 2, ("q", 0): 3, ("q", 1): 2}
    block = windows.filter("dialog = 'p' AND pass = 1 AND chunk = 2").first().blocks
    assert block.label == "2/2" and "(2/2)" in block.before and "[#0005] A: p says 4" in block.after
    done = fold.final_summaries(fold.summarise(windows, ["dialog"], Scribe), ["dialog"]).collect()
    assert {(r.dialog, r.summary, r.status) for r in done} == {(d, "+6", "done") for d in "pq"}  # the recheck has no assistant message
    kept = fold.summarise(windows, ["dialog"], lambda: Scribe(blank=(5, 6)))
    assert {r.summary for r in fold.final_summaries(kept, ["dialog"]).collect()} == {"+1+2+3+4"}


def test_stops_and_goes_on(spark):
    windows = fold.prompts_of(dialogs(spark), ["dialog"], WINDOWS)
    stopped = fold.summarise(windows, ["dialog"], lambda: Scribe(4, RateLimited("stop", 1))).collect()
    assert [(r["pass"], r.chunk, r.status, r.summary) for r in sorted(stopped, key=lambda r: (r["pass"], r.chunk)) if r.dialog == "p"] == [(0, 1, "done", "+1"), (0, 2, "done", "+1+2"), (0, 3, "done", "+1+2+3"), (1, 1, "limited", "+1+2+3")]
    state = spark.createDataFrame(stopped, fold.summarise(windows, ["dialog"]).schema)
    later = fold.summarise(windows, ["dialog"], Scribe, state=state, check=False)
    assert sorted((r["pass"], r.chunk, r.summary) for r in later.filter("dialog = 'q'").collect()) == [(-1, 0, "+1+2+3+1+2"), (1, 1, "+1+2+3+1"), (1, 2, "+1+2+3+1+2")]
    every = state.unionByName(later)
    assert fold.summarise(windows, ["dialog"], Scribe, state=every).count() == 0
    changed = dialogs(spark).withColumn("text", F.concat("text", F.lit("!")))
    assert fold.summarise(fold.prompts_of(changed, ["dialog"], WINDOWS), ["dialog"], Scribe, state=every).count() > 0
    failed = fold.summarise(windows, ["dialog"], lambda: Scribe(2, ChatError("no"))).filter("dialog = 'p'").collect()
    assert sorted(r.status for r in failed) == ["done", "failed"]
    lost = fold.final_summaries(fold.summarise(windows, ["dialog"], lambda: Scribe(6, ChatError("no"))), ["dialog"]).collect()
    assert {(r.summary, r.status) for r in lost} == {("+1+2+3+4+5", "done")}


def test_empty(spark):
    none = dialogs(spark).limit(0)
    assert fold.summarise(fold.prompts_of(none, ["dialog"], WINDOWS), ["dialog"]).count() == 0
