"""Personal data, decontamination, license and URL operators against plain versions."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ebbflow.llm import decontaminate, licenses, pii, urls

from .conftest import clashing, make_docs, words


# ---- personal data
def brute_plain(text):
    """The base patterns as regular expressions."""
    out = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        total = sum(x if i % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for i, x in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), "phone", m.end()))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[1])))


PIECES = ["a.b@c.de", "x@", "@y.z", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4539 1488 0343 6467", "4539148803436467", "+1 (415) 555-2671",
          "+44 20", "..", "-", " ", "é", "a" * 70, "7" * 30, "+", "@", ".", "0", "004.010.000.255", "b@c.d@e.f"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12))
def test_plain_identifiers(pieces):
    text = "".join(pieces)
    assert [(a, k, b) for k, a, b, plain in pii.find(text) if plain] == brute_plain(text)


@pytest.mark.parametrize("text, kind, source", [
    ("write to jane (at) example (dot) org now", "email", "jane (at) example (dot) org"),
    ("write to jane at example dot com now", "email", "jane at example dot com"),
    ("jane@mail dot example dot com", "email", "jane@mail dot example dot com"),
    ("jаne@example.org", "email", "jаne@example.org"),
    ("call plus four nine one five one two three four five six seven", "phone", "plus four nine one five one two three four five six seven"),
    ("host one nine two dot one six eight dot zero dot one up", "ip", "one nine two dot one six eight dot zero dot one"),
    ("card ４５３９１４８８０３４３６４６７ x", "card", "４５３９１４８８０３４３６４６７"),
    ("j​ane＠example․org", "email", "j​ane＠example․org")])
def test_disguised_identifiers(text, kind, source):
    assert (kind, source, False) in [(k, text[a:b], plain) for k, a, b, plain in pii.find(text)]


@pytest.mark.parametrize("text", ["we met at noon dot", "one two three four", "she looked at the dot com boom", "at (at) at", "zero", None, ""])
def test_clean_text_has_no_identifiers(text):
    assert pii.find(text) == []


def test_long_runs_are_linear():
    assert pii.find("a" * 200_000 + "@" + "9" * 200_000) == []
    assert [s[0] for s in pii.find("a" * 100_000 + "@b.c")] == ["email"]


def test_scan_and_redact(spark):
    rows = [(1, "a@b.cd and +1 (415) 555-2671", "s"), (2, None, "s"), (3, "", "s"), (4, "x at example dot org", "s"), (4, "x at example dot org", "s"),
            (None, "1.2.3.4", "s"), (5, "é 4539 1488 0343 6467", "s")]
    docs = clashing(make_docs(spark, rows))
    got = pii.scan(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for d, t, _ in rows if d == r["doc_id"]) or ""
        base = brute_plain(text)
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == k for s in base) for k in pii.KINDS]
    red = pii.redacted(docs)
    assert red.columns == docs.columns
    by = {r["doc_id"]: r for r in red.collect()}
    assert by[1]["text"] == "<EMAIL> and <PHONE>" and by[1]["n_chars"] == len(by[1]["text"])
    assert by[2]["text"] is None and by[3]["text"] == "" and by[4]["text"] == "<EMAIL>" and by[None]["text"] == "<IP>"


# ---- decontamination
def brute_distance(item, text):
    """Least edit distance of item to a substring of text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.text("abc ", min_size=1, max_size=90), st.text("abc ", max_size=120))
def test_bit_parallel_distance(item, text):
    assert decontaminate.substring_distance(item, text)[0] == brute_distance(item, text)


def test_matcher_finds_every_edited_item():
    rng = random.Random(2)
    items = [(i, words(rng, 25)) for i in range(20)]
    rate = 0.07
    matcher = decontaminate.Matcher(items, rate)
    for n in range(60):
        i, item = items[rng.randrange(20)]
        body = list(item)
        for _ in range(rng.randrange(int(rate * len(item)) + 4)):
            at = rng.randrange(len(body))
            body[at:at + 1] = rng.choice([[], ["q"], [body[at], "q"]])
        text = f"{words(rng, 30)}\n {''.join(body)}  {words(rng, 30)}"
        norm = decontaminate.normal(text)
        want = {(j, d) for j, t in items if (d := brute_distance(decontaminate.normal(t), norm)) <= int(rate * len(decontaminate.normal(t)))}
        assert {(h[0], h[1]) for h in matcher.hits(text)} == want


def test_contamination_and_clean(spark, odd):
    rng = random.Random(4)
    item = words(rng, 20)
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, item), (None, "never found anywhere in there")], "item_id long, text string")
    docs = clashing(odd.unionByName(make_docs(spark, [(100, f"x y  {item.upper()}\n z", "a"), (101, item, "a"), (101, item, "a")])))
    got = sorted(decontaminate.contamination(docs, bench).select("doc_id", "item_id", "edits").collect())
    assert got == sorted([(100, 1, 0), (100, 4, 0)] + [(101, 1, 0), (101, 4, 0)] * 2)
    spot = decontaminate.contamination(docs, bench).where("doc_id = 100 and item_id = 1").first()
    assert f"x y  {item.upper()}\n z"[spot["begin"]:spot["end"]] == item.upper()
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == odd.count()
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(docs, none).count() == docs.count() and decontaminate.contamination(docs, none).count() == 0
    blocks = decontaminate.matches  # several blocks give what one gives
    from pyspark.sql import functions as F
    many = docs.select("doc_id", F.explode(blocks(F.col("text"), bench, block_chars=50)).alias("h")).select("doc_id", "h.item_id").collect()
    assert sorted(many) == sorted((d, i) for d, i, _ in got)


# ---- licenses
def brute_licenses(text):
    """Best containment of each template in any window of its length."""
    def shingles(t):
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub(r"[A-Z]", lambda m: m.group().lower(), t))
        return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    have, found = shingles(text or ""), set()
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            want = set(shingles(t))
            for i in range(len(have) - len(want) + 1):
                if len(want & set(have[i:i + len(want)])) >= 0.8 * len(want):
                    found.add(name)
    return ",".join(sorted(found))


def test_license_scan(spark, odd, odd_rows):
    rng = random.Random(6)
    rows = []
    for i in range(40):
        name = rng.choice(sorted(licenses.TEMPLATES))
        notice = rng.choice(licenses.TEMPLATES[name]).split()
        if i % 3 == 0 and len(notice) > 14:
            notice[rng.randrange(2)] = "qq"
        elif i % 3 == 1 and len(notice) > 14:
            notice[len(notice) // 2] = "qq"
        rows.append((200 + i, f"{words(rng, 40)} {' '.join(notice)} {words(rng, 40)}", "a"))
    docs = clashing(make_docs(spark, rows + odd_rows))
    got = sorted((r["doc_id"] or 0, r["licenses"]) for r in licenses.scan(docs).collect())
    assert got == sorted((d or 0, brute_licenses(t)) for d, t, _ in rows + odd_rows)
    texts = {d: t for d, t, _ in rows}
    for r in licenses.matches(docs).where("doc_id >= 200").collect():
        for h in r["hits"]:
            spot = texts[r["doc_id"]][h["begin"]:h["end"]]
            assert spot == spot.strip() and len(spot) >= 20


def test_license_scan_of_nothing(empty):
    assert licenses.scan(empty).count() == 0


# ---- urls
URLS = ["http://A.Example.org/es/1", "https://x.example.org/en/123", "https://example.org/en/2", "http://b.com/fr/", "http://b.com/de/x", "http://com", "noscheme/free-bets",
        None, "", "http://casino-win.net/a", "http://casinos.net/", "http://free-bets.net/", "http://free-free.net", "http://x.net/?q=cheap#pills",
        "http://éadult.net/", "http://badexample.org/es/", "http://org?x", "ftp://h.net#a/b?c", "http://example.org/es", "http://WIN.net/TRACK"]


def brute_verdict(url):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fit = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    low = re.sub("[A-Z]", lambda m: m.group().lower(), url)
    terms = [t for t in urls.VOCABULARY if re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", low)]
    strict = sum(urls.VOCABULARY[t] >= urls.STRICT for t in terms)
    own = "block" if strict or len(terms) - strict >= urls.SEVERAL else "allow"
    rule, verdict = max(fit, key=lambda x: len(x[0])) if fit else (None, own)
    return host, path, rule, verdict


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u, "h", "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, html string, host string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages).collect()}
    assert got == {i: brute_verdict(u) for i, u in enumerate(URLS)}
    assert urls.judge(pages.limit(0)).count() == 0
    assert urls.judge(pages, rules=(), vocabulary={}).where("verdict = 'allow' and rule is null").count() == len(URLS)
