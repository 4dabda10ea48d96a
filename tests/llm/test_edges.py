"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing names: no operator crashes."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brute import components, leaks, shingles, simhash, slots, targets, without_common_lines, words
from rangeframe.llm import (
    decontaminate,
    html_extract,
    license_scan,
    line_dedup,
    merkle,
    mixing,
    quality,
    sharding,
    similar,
    simhash as near,
    url_filter,
)

LONG = " ".join(f"w{i % 9973}" for i in range(60_000))
RNG = random.Random(3)
VOCAB = [f"word{i}" for i in range(400)]
BASE = " ".join(RNG.choice(VOCAB) for _ in range(300))
NEAR = BASE.replace(BASE.split()[150], "changed", 1)
TEXTS = [
    None, "", " \t\n", "one", "One two", "one\n\ntwo", LONG, BASE, NEAR, BASE, "Ünï çödé x\U0001f600 y\nZ",
    "same line\nother", "SAME LINE \nthird", "\u0000odd\x0b|\x0c", "\n\n\n", "a b c d e f g h " * 20,
]
ROWS = [(i, t, "s1" if i % 3 else None, "en", None if t is None else len(t)) for i, t in enumerate(TEXTS)]
ROWS += [(7, BASE, "s1", "en", 5), (7, BASE, "s1", "en", 5), (None, "no id", "s2", None, None), (None, None, None, None, None)]
SCHEMA = "doc_id bigint, text string, source string, lang string, n_chars bigint"
#: extra columns whose names clash with what operators use inside
CLASH = ("row", "mark", "node", "key", "bucket", "size", "x", "s", "h", "label", "rank", "digest", "copy", "slice", "n")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.select("*", *(F.lit("z").alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2) for i in range(12)] + [(3, 0), (None, 1), (5, None)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int")


@pytest.fixture(scope="module")
def items(spark):
    w = BASE.split()
    rows = [(1, " ".join(w[20:60])), (2, " ".join(w[20:60]).upper()), (3, None), (4, ""), (5, "one two"), (6, LONG[:40_000]), (None, "a b c d e f")]
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_simhash_equals_brute_force(docs, clashing):
    want = components([r[0] for r in ROWS], lambda i, j: (simhash(ROWS[i][1]) ^ simhash(ROWS[j][1])).bit_count() <= 2)
    want = Counter((r[0], simhash(r[1]), w) for r, w in zip(ROWS, want))
    for table in (docs, clashing):
        got = near.simhash_groups(table).collect()
        assert Counter((r["doc_id"], r["lanes"][0] % (1 << 64), r["component_id"]) for r in got) == want


def test_simhash_stars_equal_pairs(spark):
    """Crowded variants give the same components as pairs and as brute force."""
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(4)]
    prints = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for s in seeds for _ in range(60)}
    prints = sorted(prints)
    want = components(list(range(len(prints))), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    rows = [(i, 0, [signed(p)], [p & 0xFFFFFFFF, p >> 32], signed(p)) for i, p in enumerate(prints)]
    marked = spark.createDataFrame(rows, "doc_id bigint, mark bigint, lanes array<bigint>, parts array<bigint>, node bigint")
    for limit in (1, 3, 64):
        roots = {r["node"]: r["root"]["doc_id"] for r in near.node_roots(marked, pair_limit=limit).collect()}
        assert [roots[signed(p)] for p in prints] == want


def test_near_copies_leave_one_row(clashing):
    kept = similar.first_of_groups(clashing).collect()
    ids = Counter(r["doc_id"] for r in kept)
    assert kept[0].asDict().keys() == set(clashing.columns)
    assert ids[7] == 1 and ids[8] == 0 and ids[9] == 0 and ids[6] == 1 and ids[10] == 1
    blank = [r for r in kept if not words(r["text"])]
    assert [r["doc_id"] for r in blank] == [0]


def test_similar_pairs_are_found(spark):
    rng = random.Random(9)
    rows, truth = [], []
    for group in range(40):
        base = [f"v{rng.randint(0, 5000)}" for _ in range(250)]
        rows.append((3 * group, " ".join(base)))
        for copy in (1, 2):
            other = list(base)
            for at in rng.sample(range(250), 4):
                other[at] = f"edit{rng.randint(0, 10**6)}"
            rows.append((3 * group + copy, " ".join(other)))
    sets = [set(shingles(t, 5)) for _, t in rows]
    truth = components([r[0] for r in rows], lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8)
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r["doc_id"] for r in similar.first_of_groups(table).collect()}
    assert kept == set(truth)
    # the same with every shared shingle taken for a crowd
    kept = {r["doc_id"] for r in similar.first_of_groups(table, pair_limit=1).collect()}
    assert kept == set(truth)


def test_leaks_equal_brute_force(spark, docs, items):
    rng = random.Random(2)
    listed = [(r["item_id"], r["text"]) for r in items.collect()]
    more = []
    for n in range(60):  # items of all sizes, whole, cut, edited, scattered, in short and long texts
        size = rng.choice([5, 7, 12, 40, 90, 300])
        item = [f"i{n}x{k}" for k in range(size)]
        listed.append((100 + n, " ".join(item)))
        part = item[: int(size * rng.choice([0.5, 0.85, 1.0]))]
        filler = [rng.choice(VOCAB) for _ in range(rng.choice([0, 50, 3000]))]
        at = rng.randint(0, len(filler))
        more.append((1000 + n, " ".join(filler[:at] + part[: len(part) // 2] + (["gap"] * (n % 2)) + part[len(part) // 2 :] + filler[at:])))
    rows = [(r[0], r[1]) for r in ROWS if r[0] is not None] + more
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    asked = spark.createDataFrame([r for r in listed if r[0] is not None], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in decontaminate.find_leaks(table, asked).collect()}
    assert got == leaks(rows, [r for r in listed if r[0] is not None])
    clean = decontaminate.without_leaks(docs.select("*", F.lit(1).alias("mark")), items)
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(r[0] for r in ROWS if r[0] not in (4, 5, 6, 7, 8, 9, 15))


def test_lines_equal_brute_force(docs, clashing):
    rows = [(r[0], r[1]) for r in ROWS]
    for least in (2, 3, 100):
        want = Counter(without_common_lines(rows, least))
        for table in (docs, clashing):
            got = line_dedup.drop_common_lines(table, min_docs=least, batches=3).collect()
            assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got) == want


def test_line_runs_keep_levels_and_recall_batches(spark):
    runs = line_dedup.LineRuns(spark, fan_in=2, buckets=4)
    batches = [["a", "b"], ["b", "c"], ["d"], ["a", "d", "e"], ["f"]]
    seen: set[str] = set()
    for number, lines in enumerate(batches, 1):
        table = spark.createDataFrame([(number, "\n".join(lines))], "doc_id bigint, text string")
        row = line_dedup.first_seen_lines(runs, table).collect()[0]
        assert row["kept_text"].split("\n") == ([x for x in lines if x not in seen] or [""])
        seen |= set(lines)
        assert [len(level) for level in runs.levels] == [int(d) for d in reversed(f"{number:b}")]
    counts = {r["line_key"]: r["n_docs"] for r in runs.counts().collect()}
    assert counts == Counter(hashlib.md5(x.encode()).hexdigest() for lines in batches for x in lines)
    runs.drop()


def test_fingerprints_follow_the_order_of_ids(docs, clashing):
    rows = sorted(((r[0] if r[0] is not None else -(1 << 63)), r[0], r[1] or "") for r in ROWS)
    for table in (docs, clashing):
        got = merkle.edited_fingerprints(table).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ROWS)
        texts = {}
        for _, key, text in rows:
            texts.setdefault(key, set()).add(text)
        for r in got:
            for text in texts[r["doc_id"]]:
                if merkle.fingerprint(text) == r["fingerprint"]:
                    assert r["n_chars"] == len(text)
    whole = [(k, (t or "")) for k, t, *_ in ROWS[:16]]
    got = {r["doc_id"]: r for r in merkle.edited_fingerprints(docs.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    for i, (key, text) in enumerate(whole):
        other = whole[i - 1][1]
        edited = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
        assert got[key]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[key]["edited_fingerprint"] == merkle.fingerprint(edited)
        assert (got[key]["near_edited"] == 1) == (edited == text) and (got[key]["near_next"] == 1) == (other == text)


def test_fingerprints_tell_texts_apart_and_locate_edits():
    old = "\n".join(f"paragraph {i} with some words of its own and a few more to fill it {i * i}" for i in range(60))
    new = old.replace("paragraph 31 with", "paragraph 31 without")
    a, b = merkle.fingerprint(old), merkle.fingerprint(new)
    assert a != b and 0.9 < merkle.likeness(a, b) < 1 and merkle.likeness(a, a) == 1
    places = merkle.differences(a, b)
    assert places and merkle.differences(a, a) == []
    section = b[33:].split("|")[places[0][0]].split("/")[places[0][1]]
    assert section not in a and len({p[:2] for p in places}) == 1
    texts = ["", "\n", "\n\n", " ", "a", "a\n", "\na", "a b", "ab", "a  b"]
    assert len({merkle.fingerprint(t) for t in texts}) == len(texts) and merkle.fingerprint(None) == merkle.fingerprint("")


def test_mix_meets_targets(docs, clashing):
    for table in (docs, clashing):
        got = mixing.mix(table).collect()
        assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(words(r[1]))) for r in ROWS)
        sizes = Counter()
        for r in ROWS:
            sizes[r[2]] += len(words(r[1]))
        want = targets(sizes, mixing.WEIGHTS, 3)
        assert sorted({round(r["target"], 6) for r in got}) == sorted({round(t, 6) for t in want.values()})
        assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in got)
    again = mixing.mix(docs)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, mixing.mix(docs.repartition(5)).collect()))
    mixed = mixing.mixed_documents(clashing)
    assert mixed.columns == clashing.columns
    assert mixed.count() == sum(r["copies"] for r in again.collect())


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(1.2) * 20)), f"s{int(rng.paretovariate(0.9)) % 7}") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    for r in got.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("most")).collect():
        assert abs(r["taken"] - r["target"]) <= max(25, 0.01 * r["target"])


def test_shards(docs, clashing):
    names = [f"n{i}" for i in range(7)]
    assert sharding.fill_slots(names, 1009) == slots(names, 1009, sharding._number)
    share = Counter(sharding.fill_slots(names, 1009))
    assert max(share.values()) - min(share.values()) <= 1
    before, after = sharding.fill_slots(names, 8191), sharding.fill_slots(names[:-1], 8191)
    moved = sum(a != b for a, b in zip(before, after) if a != 6)
    assert moved < 0.1 * 8191
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill_slots(bad, 1009)
    with pytest.raises(ValueError):
        sharding.fill_slots(names, 1000)
    placed = sharding.place(clashing, "doc_id", names, slots=1009)
    assert placed.columns == [*clashing.columns, "slot", "shard"]
    table = sharding.fill_slots(names, 1009)
    for r in placed.collect():
        digest = hashlib.md5(str("" if r["doc_id"] is None else r["doc_id"]).encode()).hexdigest()
        assert r["slot"] == int(digest[:15], 16) % 1009 and r["shard"] == table[r["slot"]]
    again = sharding.place(placed, "doc_id", names, slots=1009)
    assert again.columns == placed.columns and again.count() == len(ROWS)


RULES = [url_filter.Rule("org", "/", "allow"), url_filter.Rule("bad.org", "/x", "block"), url_filter.Rule("evil.com", "/", "block")]
PAGES = [
    (1, "http://a.org/p?q", "<a href='http://friend.net/1'>x</a>"),
    (2, "https://WWW.Bad.org/x/1#f", None),
    (3, "https://bad.org/", ""),
    (4, "http://friend.net", "text"),
    (5, "http://shady.net/a", '<a href="//evil.com/q">x</a> <A HREF=http://evil.com/2>y</A>'),
    (6, "http://evil.com/a", "<p>hi"),
    (7, None, "<a href=http://evil.com>z</a>"),
    (8, "no-scheme/x", "<p>one</p>"),
    (9, "http://", "<p>"),
    (10, "http://notorg/", None),
    (1, "http://a.org/p?q", "<a href='http://friend.net/1'>x</a>"),
]


def test_urls(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").select("*", F.lit(1).alias("fit"), F.lit(2).alias("h"))
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, RULES).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(1, 11)] == [
        ("a.org", "/p", "org/"), ("www.bad.org", "/x/1", "bad.org/x"), ("bad.org", "/", "org/"), ("friend.net", "", None),
        ("shady.net", "/a", None), ("evil.com", "/a", "evil.com/"), ("", "", None), ("", "", None), ("", "", None), ("notorg", "/", None),
    ]
    assert [got[i]["verdict"] for i in range(1, 11)] == ["allow", "block", "allow", "allow", "block", "block", *["allow"] * 4]
    assert got[4]["trust"] > 0 and got[5]["distrust"] > 0 and got[10]["trust"] == 0
    assert url_filter.judge_urls(pages, RULES).count() == len(PAGES)
    assert {r["verdict"] for r in url_filter.judge_urls(pages, []).collect()} == {"allow"}


def test_propagation_equals_brute_force(spark):
    rng = random.Random(4)
    edges = [(f"h{rng.randint(0, 9)}", f"h{rng.randint(0, 9)}", rng.randint(1, 5)) for _ in range(25)]
    edges = list({(a, b): (a, b, n) for a, b, n in edges if a != b}.values())
    seeds = [("trust", "h1", 2), ("trust", "h2", 1), ("distrust", "h3", 1)]
    got = url_filter.propagate(
        spark.createDataFrame(edges, "src string, dst string, links bigint"), spark.createDataFrame(seeds, "kind string, host string, weight bigint"), rounds=4
    )
    got = {(r["kind"], r["host"]): r["mass"] for r in got.collect()}
    for kind in ("trust", "distrust"):
        total = sum(w for k, _, w in seeds if k == kind)
        start = {h: w / total for k, h, w in seeds if k == kind}
        ways = [(a, b, n) if kind == "trust" else (b, a, n) for a, b, n in edges]
        out = Counter()
        for a, _, n in ways:
            out[a] += n
        mass = dict(start)
        for _ in range(4):
            nxt = Counter({h: 0.15 * v for h, v in start.items()})
            for a, b, n in ways:
                nxt[b] += 0.85 * mass.get(a, 0) * n / out[a]
            mass = nxt
        for h, v in mass.items():
            assert abs(got.get((kind, h), 0) / url_filter.UNITS - v) < 1e-9


HTML = """<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1></header><div id=menu><a href=/>x</a></div>
<div class="wrap7"><div class="cookie-notice">We use cookies a lot here</div><article><header><h2>Head</h2><p class=byline>by me</p></header>
<p>One &amp; two<br>three <b>bold<p>Four&nbsp;five</p><ul><li>a<li>b</ul><table><tr><td>c<td>d</table>
<form>Name <input></form><div class="ad">buy!</div><script>var x="<p>no</p>"</script><!-- <p>gone</p> --></article>
<section class="comments"><p>Great article blah blah blah blah blah blah blah blah</p></section></div><aside>side</aside><footer>&copy; foot</footer>"""


def test_html(spark):
    thin = "<body><div class='wrap1'><article><p>tiny</p></article></div><div class=list><p>more words than the article has, many more of them</p></div>"
    rows = [(1, "http://a/1", HTML), (2, "http://a/2", thin), (3, "http://a/3", None), (4, None, ""), (5, "http://b/", "plain &lt;text&gt;"),
            (6, "http://c/", "<p>x"), (7, "http://a/7", "<div>" * 2000 + "<p>deep"), (1, "http://a/1", HTML), (8, "http://b/", "<script>never closed <p>x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").select("*", F.lit(1).alias("path"), F.lit(1).alias("host"))
    got = {r["page_id"]: r for r in html_extract.extract_pages(pages).collect()}
    assert got[1]["text"] == "Head\nOne & two three bold\nFour five\na\nb\nc d"
    assert got[2]["text"] == "tiny"  # the host's path, not the page's longest container
    assert [got[i]["text"] for i in (3, 4, 5, 6, 7, 8)] == ["", "", "plain <text>", "x", "deep", ""]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_extract.extract_pages(pages).count() == len(rows)
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_licenses(spark, docs):
    rng = random.Random(6)
    rows, want = [], {}
    for n, (name, text) in enumerate(license_scan.TEMPLATES.items()):
        lines = [" ".join(rng.choice(VOCAB) for _ in range(12)) for _ in range(5)]
        lines.insert(n % 5, text)
        rows.append((n, "\n".join(lines)))
        want[n] = (name, n % 5)
    rows += [(100, "my driving licence expired"), (101, None), (102, ""), (103, "Released under the MIT License.\nRELEASED under the  MIT license\nx")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", F.lit(1).alias("block"))
    got = license_scan.scan_licenses(table).collect()
    exact = {r["doc_id"]: (r["license"], r["line"]) for r in got if r["exact"] and r["doc_id"] < 100}
    assert exact == want
    texts = dict(rows)
    assert all(texts[r["doc_id"]][r["start"] : r["stop"]] == r["block"] for r in got)
    assert {r["license"] for r in got if r["doc_id"] == 103} == {"mit-short"} and not any(r["confirmed"] for r in got if r["doc_id"] == 100)
    edited = license_scan.scan(license_scan.TEMPLATES["mit"].replace("free of charge", "at no cost"), license_scan.Scanner(license_scan.TEMPLATES))
    assert edited[0][4] == "mit" and edited[0][7] == ["free", "of", "charge"] and edited[0][8] == ["at", "no", "cost"] and edited[0][9]
    assert license_scan.scan_licenses(docs).filter("confirmed").count() == 0
    assert license_scan.scan_licenses(table, {}).count() == 0


def test_quality(docs, clashing, labels, empty):
    for table in (docs, clashing):
        got = quality.score_documents(table, labels).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ROWS)
        assert all(0 <= r["score"] <= 1 for r in got)
    kept = quality.good_documents(clashing, labels)
    assert kept.columns == clashing.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if r["keep"])
    assert all(r["score"] == 1 for r in quality.score_documents(docs, labels.limit(0)).collect())
    assert quality.score_documents(docs.select("doc_id", "text"), labels).count() == len(ROWS)


def test_quality_on_held_out_labels(spark):
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(1500):
        bad = i % 5 == 0
        tokens = [rng.choice(VOCAB) for _ in range(rng.randint(20, 200))]
        text = " ".join(t.upper() + "!!" for t in tokens[:20] * 5) if bad else "\n".join(" ".join(tokens[k : k + 15]) for k in range(0, len(tokens), 15))
        rows.append((i, text, f"s{i % 4}", "en", len(text)))
        marks.append((i, int(not bad)))
    table = spark.createDataFrame(rows, SCHEMA)
    given = spark.createDataFrame(marks[:300], "doc_id bigint, quality int")
    truth = dict(marks)
    got = quality.score_documents(table, given).collect()
    unseen = [r for r in got if r["doc_id"] >= 300]
    assert sum(r["keep"] == bool(truth[r["doc_id"]]) for r in unseen) > 0.98 * len(unseen)


def test_empty_tables(spark, empty, labels, items):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert near.simhash_groups(empty).count() == similar.first_of_groups(empty).count() == 0
    assert decontaminate.find_leaks(empty, items).count() == decontaminate.without_leaks(empty, items).count() == 0
    assert decontaminate.find_leaks(empty, items.limit(0)).count() == 0
    assert line_dedup.drop_common_lines(empty).count() == merkle.edited_fingerprints(empty).count() == 0
    assert mixing.mix(empty).count() == mixing.mixed_documents(empty).count() == 0
    assert sharding.place(empty, "doc_id", ["a"]).count() == url_filter.judge_urls(pages, RULES).count() == 0
    assert quality.score_documents(empty, labels).count() == quality.good_documents(empty, labels).count() == 0
    assert license_scan.scan_licenses(empty).count() == html_extract.extract_pages(pages).count() == 0


def test_single_document_follows_itself(spark):
    one = spark.createDataFrame([(5, "abcd")], "doc_id bigint, text string")
    row = merkle.edited_fingerprints(one).collect()[0]
    assert row["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and row["near_next"] == 1
    same = spark.createDataFrame([(3, "x y")], "doc_id bigint, text string")
    assert decontaminate.without_leaks(same, spark.createDataFrame([], "item_id bigint, text string")).count() == 1
