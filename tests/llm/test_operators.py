"""Operators against brute force on small tables with nulls, empty, blank, long, equal and clashing rows."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netweft.llm import classifier, jaccard, licenses, matroska, mixing, packing, rules, scoring, sharding, tokens, warc
from netweft.llm.components import components
from netweft.llm.queries import vocabulary

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, row int, n int, target double"


def words(text, lower=True):
    raw = (text or "").encode()
    raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw) if lower else raw
    return WORD.findall(raw)


def make(spark, rows):
    """Rows (id, text[, source]) with columns whose names clash with those that operators use."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "a", 0, 7, "x", 1, 2, 0.5) for r in rows], SCHEMA)


def corpus():
    rng = np.random.default_rng(3)
    vocab = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choice(vocab, 60))
    rows = []
    for k in range(60):
        rows.append((k, " ".join(rng.choice(vocab, int(rng.integers(20, 300)))), f"s{k % 4}"))
    for k in range(60, 75):  # near copies with a few words changed
        t = rows[k % 10][1].split(" ")
        for _ in range(k % 4):
            t[int(rng.integers(len(t)))] = "changed"
        rows.append((k, " ".join(t), "s1"))
    for k in range(75, 130):  # a passage that many share
        rows.append((k, " ".join(rng.choice(vocab, 150)) + "\n" + passage, "s2"))
    base = rng.choice(vocab, 120)
    for k in range(130, 200):  # a large group of near copies, chained
        t = list(base)
        t[k - 130] = f"n{k}"
        rows.append((k, " ".join(t), "s0"))
    rows += [(200, None, None), (201, "", "s1"), (202, " \t\n", "s1"), (203, "one two", "s2"), (204, "ONE two", "s2"), (205, "é ü ñ 漢字 😀 x", None), (None, "one two", "s3"), (7, rows[7][1], "s3"), (206, "a b c d e " * 8000, "s3")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, corpus()).repartition(5)


def empty(spark):
    return make(spark, corpus()[:1]).where("doc_id < 0")


# -- tokens -----------------------------------------------------------------------------------------


def test_blocks_find_all_words():
    import pyarrow as pa

    texts = [r[1] for r in corpus()]
    for size in (50, 1 << 20):
        got = []
        for b in tokens.blocks(pa.array(texts), size=size):
            h = b.hashes()
            got += [[b.data[s:e].tobytes() for s, e in zip(b.start[i:j], b.end[i:j])] for i, j in zip(b.first[:-1], b.first[1:])]
            assert len(h) == len(b.start)
        assert got == [words(t) for t in texts]


def test_hashes_depend_on_the_word_alone():
    import pyarrow as pa

    seen = {}
    for b in tokens.blocks(pa.array(["x ab abc ab", "abc", "\tab\n"])):
        for h, s, e in zip(b.hashes().tolist(), b.start, b.end):
            assert seen.setdefault(b.data[s:e].tobytes(), h) == h
    assert len(set(seen.values())) == 3


# -- op1 ----------------------------------------------------------------------------------------------


def rules_brute(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = defaultdict(list)
    for k in range(len(w) - 7):
        at[tuple(w[k : k + 8])].append(k)
    covered = {p + d for v in at.values() if len(v) > 1 for p in v for d in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_rules_counts(spark, docs):
    extra = [(300, "a b\na b\n\n \nA b", "s"), (301, "x#y *$%&|<> z", "s"), (302, "p q r s t u v w " * 3 + "end", "s")]
    got = rules.judge(docs.unionByName(make(spark, extra))).collect()
    want = Counter((r[0], *rules_brute(r[1])) for r in corpus() + extra)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["failed_rules"] == "")


def test_rules_run_no_python_and_take_empty_tables(spark, docs):
    plan = rules.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert rules.judge(empty(spark)).count() == 0


# -- op2 ----------------------------------------------------------------------------------------------


def test_matroska_round_trip(spark, docs):
    media = matroska.store(docs)
    got = {(r["doc_id"], r["payload_sha256"]): r for r in matroska.features(media).collect()}
    for doc_id, text, *_ in corpus():
        raw = (text or "").encode()
        payload = raw + b"\0" * (64 - len(raw) if len(raw) < 64 else -len(raw) % 64)
        r = got[doc_id, hashlib.sha256(payload).hexdigest()]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(payload), zlib.crc32(payload[-64:]))
    assert matroska.store(empty(spark)).count() == 0
    table = matroska.packets(media).where("doc_id = 206").orderBy("packet").collect()
    assert [r["timestamp"] for r in table] == [sum(x["length"] for x in table[:k]) // 64 for k in range(len(table))]
    assert {r["lacing"] for r in matroska.packets(media).select("lacing").distinct().collect()} >= {0, 2, 3}
    clusters = {r["cluster"] for r in table}
    assert len(clusters) > 1
    index = matroska.cues(media).where("doc_id = 206").orderBy("time").collect()
    m = media.where("doc_id = 206").first()["media"]
    for c in index:  # each cue points at a cluster's element
        assert m[c["position"] : c["position"] + 4] == bytes.fromhex("1F43B675")


@pytest.mark.parametrize("kind", [1, 2, 3])
def test_lacing_and_unknown_sizes(kind):
    sizes = [300, 300, 300] if kind == 2 else [300, 10, 700]
    data = bytes(np.random.default_rng(kind).integers(0, 256, sum(sizes), dtype=np.uint8))
    block = matroska._element(matroska.SIMPLE_BLOCK, b"\x81\x00\x05" + bytes([kind << 1]) + matroska._lace(sizes, kind) + data)
    group = matroska._element(matroska.BLOCK_GROUP, matroska._element(matroska.BLOCK, b"\x82\x00\x07\x00" + b"abc"))
    cluster = matroska._id(matroska.CLUSTER) + b"\xff" + matroska._uint(matroska.TIMESTAMP, 100) + block + group
    file = matroska._element(matroska.EBML, b"") + matroska._id(matroska.SEGMENT) + b"\x01" + b"\xff" * 7 + cluster + cluster
    found, _, _ = matroska.demux(file)
    assert [p.length for p in found] == (sizes + [3]) * 2
    assert b"".join(file[p.offset : p.offset + p.length] for p in found[:3]) == data
    assert found[0].timestamp == 105 and found[3].timestamp == 107 and found[3].track == 2


def test_vint_widths_and_bad_files():
    for x in (0, 1, 126, 127, 128, 16382, 16383, 2**20, 2**35, 2**55):
        v = matroska.vint(x)
        assert matroska.read_vint(v, 0)[:2] == (x, len(v))
    with pytest.raises(ValueError):
        matroska.demux(b"\x00\x01")
    with pytest.raises(ValueError):
        matroska.demux(matroska.mux(b"a" * 64)[:-20])


# -- op3 ----------------------------------------------------------------------------------------------


def components_brute(rows):
    sets = []
    for _, text, *_ in rows:
        w = words(text)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            root[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(rows[k][0])
    out = Counter()
    for k, r in enumerate(rows):
        ids = [i for i in groups[find(k)] if i is not None]
        out[r[0], len(sets[k]), (min(ids) if ids else None) if sets[k] else r[0]] += 1
    return out


def as_counter(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def test_jaccard_join_is_exact(spark, docs):
    assert as_counter(jaccard.join(docs)) == components_brute(corpus())
    assert jaccard.join(empty(spark)).count() == 0


def test_jaccard_join_with_small_regions(spark, docs, monkeypatch):
    """Small bounds send the same table through every level: large regions, pivots, splits."""
    monkeypatch.setattr(jaccard, "REGION", 4)
    assert as_counter(jaccard.join(docs)) == components_brute(corpus())


def test_regions_beyond_a_task_are_split(spark):
    rng = np.random.default_rng(5)
    sets, region = [], []
    for g in range(6):
        base = rng.integers(0, 1 << 60, 80)
        for _ in range(40):
            s = base.copy()
            s[: int(rng.integers(0, 14))] = rng.integers(0, 1 << 60, 1)
            sets.append(sorted({int(x) for x in s}))
            region.append(g % 2)
    rows = [(region[k], k, len(s), s) for k, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "region long, sig long, n long, set array<long>")
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(sets)), 2):
        x, y = set(sets[a]), set(sets[b])
        if region[a] == region[b] and 4 * len(x & y) >= 3 * len(x | y):
            i, j = find(a), find(b)
            root[max(i, j)] = min(i, j)
    want = {k: find(k) for k in range(len(sets))}
    for most in (16, 60, 4096):
        found = {r["node"]: r["root"] for r in components(jaccard.join_regions(df, most, 1 << 30)).collect()}
        assert {k: found.get(k, k) for k in want} == want


def links_brute(rows):
    sets = []
    for _, text, *_ in rows:
        w = words(text)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset())
    n = [0] * len(rows)
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            n[a] += 1
            n[b] += 1
    return Counter((r[0], len(s), k) for r, s, k in zip(rows, sets, n))


@pytest.mark.parametrize("bounds", [{}, {"REGION": 4}, {"REGION": 4, "LEAF": 8, "HEAVY": 4, "CHUNK": 16}])
def test_jaccard_join_counts_all_links(spark, monkeypatch, bounds):
    for k, x in bounds.items():
        monkeypatch.setattr(jaccard, k, x)
    rows = corpus() + [(300 + k, corpus()[140 + k % 3][1], "s0") for k in range(9)]  # some sets stand for several rows
    got = jaccard.join(make(spark, rows).repartition(5)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["n_links"]) for r in got) == links_brute(rows)


def test_jaccard_links_equal_their_sql(spark, sf):
    import duckdb

    from netweft.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.sql(SQL["op3_jaccard_links"]).to_arrow_table()
    got = QUERIES["op3_jaccard_links"](spark, sf)
    assert got.columns == want.column_names
    assert Counter(map(tuple, got.collect())) == Counter(zip(*(c.to_pylist() for c in want.columns)))
    assert got.where("n_links > 0").count() > 0


@pytest.mark.parametrize("alike", [True, False])
def test_regions_count_each_link_once(spark, alike):
    """Also where pivots split a region across the cluster, and where they don't and blocks do."""
    rng = np.random.default_rng(8)
    bases = [rng.integers(0, 1 << 60, 80) for _ in range(1 if alike else 6)]
    sets = []
    for k in range(150):
        s = bases[k % len(bases)].copy()
        s[: int(rng.integers(1, 14))] = rng.integers(0, 1 << 60, 1)
        sets.append(sorted({int(x) for x in s}))
    rows = [(7, k, len(s), s, 1 + k % 3) for k, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "region long, sig long, n long, set array<long>, m long")
    want = Counter()
    for a, b in combinations(range(len(sets)), 2):
        if 4 * len(set(sets[a]) & set(sets[b])) >= 3 * len(set(sets[a]) | set(sets[b])):
            want[a] += rows[b][4]
            want[b] += rows[a][4]
    for most in (20, 60, 4096):
        got = jaccard.found_in(df, most, 1 << 30).where("b IS NULL").groupBy("a").agg(F.sum("c").alias("c")).collect()
        assert {r["a"]: r["c"] for r in got} == dict(want)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(k, k + 1) for k in range(50)] + [(100 + int(a), 100 + int(b)) for a, b in rng.integers(0, 60, (50, 2))] + [(-5, 300), (300, 301)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        i, j = find(a), find(b)
        root[max(i, j)] = min(i, j)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- op4 ----------------------------------------------------------------------------------------------


def test_mixing_meets_targets(spark, docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(corpus())
    size = Counter()
    for _, text, source in corpus():
        size[source] += len(words(text))
    total = sum(size.values())
    order = sorted((s for s in size if s is not None), key=str) + [None] * (None in size)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    low, high = 0.0, 1e9
    for _ in range(200):  # the rate at which capped targets sum up to everything
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3 * size[s], mid * weight[s]) for s in size) < total else (low, mid)
    taken = Counter()
    largest = Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(min(3 * size[r["source"]], low * weight[r["source"]]), rel=1e-9)
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["repeats"] * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in size:
        assert abs(taken[s] - min(3 * size[s], low * weight[s])) <= largest[s]
    assert Counter(map(tuple, mixing.mix(docs).collect())) == Counter(map(tuple, got))
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mix(make(spark, [(1, None), (2, " ")])).agg(F.sum("taken"), F.max("target")).first() == (0, 0.0)


def test_mixing_tells_rows_apart(spark):
    """Null and repeated ids, and rows equal throughout: every source's taken words come within its largest document of its target."""
    rng = np.random.default_rng(8)
    rows = [(None if k % 5 < 3 else k % 40, " ".join(rng.choice(["a", "bc", "def"], int(rng.integers(1, 60)))), f"s{k % 6}") for k in range(600)]
    rows += [(None, "the same text each time", f"s{k % 2}") for k in range(800)] + [(5, "one two three", "s3")] * 300
    table = make(spark, rows).repartition(6)
    got = mixing.mix(table).collect()
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in got) == Counter((i, len(t.split()), s) for i, t, s in rows)
    taken, largest, target = Counter(), Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        target[r["source"]] = r["target"]
    for s in target:
        assert abs(taken[s] - target[s]) <= largest[s]
    # The same number of each kind of row whatever the partitions, and as many rows as the operator hands on.
    kinds = Counter((r["doc_id"], r["size"], r["source"], r["repeats"]) for r in got)
    assert kinds == Counter((r["doc_id"], r["size"], r["source"], r["repeats"]) for r in mixing.mix(table.repartition(3)).collect())
    given = Counter((r["doc_id"], len((r["text"] or "").split()), r["source"]) for r in mixing.sample(table).collect())
    want = Counter()
    for (i, n, s, k), m in kinds.items():
        want[i, n, s] += k * m
    assert given == +want


# -- op5 ----------------------------------------------------------------------------------------------


def test_sharding_is_balanced_and_gapless(spark, docs):
    got = sharding.shard(docs).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == len(corpus()) and max(counts.values()) - min(counts[s] for s in range(24)) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in corpus())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    assert sharding.shard(empty(spark)).count() == 0


def test_ring_moves_few_keys():
    points = sharding.ring(24)
    more = sharding.ring(25)
    assert [p for p in more if p[1] < 24] == points  # old points stay
    rng = np.random.default_rng(0)
    cells, grown = Counter(), Counter()
    keys = rng.integers(0, 1 << 31, 40_000)
    where, there = {}, {}
    for pts, table, out in ((points, cells, where), (more, grown, there)):
        starts = [p for p, _ in pts]
        arcs = np.searchsorted(starts, keys) % len(starts)
        for k, a in enumerate(arcs.tolist()):
            table[a, k % 16] += 1
        plan = sharding.place(dict(table), pts, max(s for _, s in pts) + 1)
        seen = Counter()
        for k, a in enumerate(arcs.tolist()):
            n = seen[a, k % 16]
            seen[a, k % 16] += 1
            out[k] = next(s for r, m, s, _ in plan[a, k % 16] if r <= n < r + m)
        loads = Counter(out.values())
        assert max(loads.values()) - min(loads.values()) <= 1
    moved = sum(where[k] != there[k] for k in where) / len(where)
    assert moved < 0.35  # dealing anew would move 24 of 25


# -- op6 ----------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    rows = [(k, f"http://x/é {k}", f"<html>{'body ' * (k % 7)}</html>") for k in range(40)]
    rows += [(41, "u", None), (42, None, ""), (43, "u", "<b>ü</b>"), (43, "v", "<b>ü</b>"), (None, "n", "<b>ü</b>"), (44, "u", "x" * 500_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, key int").repartition(3)
    archives = warc.write(pages)
    got = warc.records(archives).collect()
    largest = {}
    for i, _, html in rows:
        largest[html or ""] = max(largest.get(html or "", -1), -1 if i is None else i)
    assert len(got) == len(rows)
    responses = Counter()
    for r in got:
        html = next((h or "") for i, _, h in rows if i == r["page_id"])
        assert r["payload_bytes"] == len(html.encode())
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        if r["record_type"] == "response":
            responses[html] += 1
            assert r["page_id"] == largest[html] and r["refers_to"] is None and r["payload"].decode() == html
        else:
            assert r["refers_to"] == largest[html]
    assert set(responses.values()) == {1} and len(responses) == len(largest)
    names = warc.export(archives, str(tmp_path))
    with open(names[0], "rb") as f:
        assert f.read(4) == b"\x5d\x2a\x4d\x18"
    assert warc.records(warc.write(pages.where("page_id < 0"))).count() == 0


# -- op7 ----------------------------------------------------------------------------------------------


def test_classifier_learns(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    got = classifier.classify(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").toPandas()
    assert len(got) > 900
    assert (got["predicted"] == got["quality"]).mean() > 0.97
    good, bad = got[got["quality"] == 1]["score"].to_numpy(), got[got["quality"] == 0]["score"].to_numpy()
    auc = ((good[:, None] > bad) + 0.5 * (good[:, None] == bad)).mean()
    assert auc > 0.97
    assert (got["score"].between(0, 1)).all()


def test_classifier_edges(spark, docs):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(100)] + [(None, 1, 0), (5, None, 0), (5, 1, 0)], "doc_id long, quality int, x int")
    got = classifier.classify(docs, labels).collect()
    assert len(got) == len(corpus()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    none = classifier.classify(docs, labels.where("doc_id < 0")).select("score").distinct().collect()
    assert [r["score"] for r in none] == [0.5]
    assert classifier.classify(empty(spark), labels).count() == 0


def test_isotonic():
    x, y = classifier.isotonic(np.arange(6.0), np.array([0.0, 0.5, 0.3, 0.2, 0.9, 0.8]), np.ones(6))
    assert np.all(np.diff(y) > 0) and np.all(np.diff(x) > 0)
    assert y.tolist() == pytest.approx([0.0, 1 / 3, 0.85])


# -- op8 ----------------------------------------------------------------------------------------------


def test_packing_ids_and_places(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    got = packing.pack(packing.pieces(docs, vocabulary())).collect()
    want = Counter()
    total = 0
    for doc_id, text, *_ in corpus():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        first = len(ids) % 2048 or 2048
        bounds = [0, *range(first, len(ids), 2048), len(ids)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want[doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 11 / 9 * -(-total // 2048) + 1
    assert packing.pack(packing.pieces(empty(spark), vocabulary())).count() == 0


def test_best_fit_decreasing_equals_one_by_one():
    rng = np.random.default_rng(2)
    for _ in range(30):
        capacity = int(rng.integers(8, 60))
        lengths = sorted(rng.integers(1, capacity + 1, int(rng.integers(1, 300))).tolist(), reverse=True)
        room = []
        for n in lengths:
            fits = [r for r in room if r >= n]
            if fits:
                room.remove(min(fits))
                room.append(min(fits) - n)
            else:
                room.append(capacity - n)
        plan, bins = packing.best_fit_decreasing(Counter(lengths), capacity)
        assert bins == len(room)
        used = defaultdict(list)
        for n, _, k, first, offset in plan:
            for b in range(first, first + k):
                assert offset == sum(used[b])
                used[b].append(n)
        assert sorted(capacity - sum(u) for u in used.values()) == sorted(room)
        assert Counter(x for u in used.values() for x in u) == Counter(lengths)


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    ours = packing.Encoder(vocabulary())
    texts = ["", " ", "a  b", "x\n\n y", "don't we'll", "<|endoftext|> hi", "日本語 한국어 😀\n", "".join(map(chr, range(1, 0x600))), "a" * 3000]
    for x in texts:
        assert np.frombuffer(ours(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 1_001_000, "\n" * 2_000_000 + "x", "a" + " \u00a0" * 600_000 + " b"])
def test_encoder_takes_white_space_of_any_length(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(vocabulary()).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.Encoder(vocabulary())(text), "<u4").tolist() == want


def test_encoder_falls_back_when_the_fast_engine_fails(monkeypatch):
    """Without the bound on white space the engine itself fails, and the library takes the text."""
    monkeypatch.setattr(packing, "BLANKS", 1 << 40)
    text = " " * 1_001_000
    assert len(packing.Encoder(vocabulary())(text)) == 4 * 1_001_000


def test_packing_inserts_added_tokens(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())  # with its default settings
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "<|endoftext|><|endoftext|>  a\n", "<|endoftext", "x" + " " * 50 + "<|endoftext|>" + "\n" * 3]
    ours = packing.Encoder(vocabulary())
    for plain in (True, False):
        ours.plain = plain
        for x in texts:
            assert np.frombuffer(ours.with_added(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pieces(make(spark, list(enumerate(texts))), vocabulary()).collect()}
    ids = [[*t.encode(x, add_special_tokens=False).ids, 0] for x in texts]
    assert got == {k: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in enumerate(ids)}


# -- op9 ----------------------------------------------------------------------------------------------


def test_license_scan(spark):
    rows = [
        ("p/LICENSE", "Released under the MIT License"), ("p/a.txt", "nothing"), ("p/q/b.txt", None), ("p/q/LICENSE", "This work is licensed under the GNU General Public License, version 3."),
        ("p/q/r/c.txt", ""), ("p/q/d.txt", "text\nLicensed under CC BY-NC 4.0.\nmore"), ("z/e.txt", "no"), (None, "Licensed under the Apache License, Version 2.0."), ("f.txt", "x"), ("p2/g.txt", "y"),
    ]
    df = spark.createDataFrame([(k, p, t, "clash") for k, (p, t) in enumerate(rows)], "doc_id long, path string, text string, license string")
    got = {r["doc_id"]: (r["license"], r["inherited_from"]) for r in licenses.scan(df).collect()}
    assert got == {
        0: ("MIT", None), 1: ("MIT", "p"), 2: ("GPL-3.0", "p/q"), 3: ("GPL-3.0", None), 4: ("GPL-3.0", "p/q"), 5: ("CC-BY-NC-4.0", None), 6: (None, None), 7: ("Apache-2.0", None), 8: (None, None), 9: (None, None),
    }
    assert licenses.scan(df.where("doc_id < 0")).count() == 0


# -- op10 ---------------------------------------------------------------------------------------------


def test_scoring_base_and_model(spark, docs):
    got = scoring.score(docs).collect()
    assert len(got) == len(corpus())
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter()
    for i, text, *_ in corpus():
        if not held(i):
            counts.update(words(text))
            counts["end"] += 1
    n, v = sum(counts.values()), len(counts)
    want = {}
    for i, text, *_ in corpus():
        t = [*words(text), "end"]
        want[i, text] = (len(t), sum(counts[x] > 0 for x in t), sum(np.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t))
    by_id = defaultdict(list)
    for (i, _), x in want.items():
        by_id[i].append(x)
    for r in got:
        assert r["held_out"] == held(r["doc_id"]) and r["train_tokens"] == n
        assert any((r["n_tokens"], r["n_known"]) == x[:2] and r["base_score"] == pytest.approx(x[2], abs=1e-6) for x in by_id[r["doc_id"]])
        assert r["score"] < 0
    assert scoring.score(empty(spark)).count() == 0


def test_scoring_without_common_words(spark, docs, monkeypatch):
    """All counts come by the join; results stay the same."""
    a = {(r["doc_id"], r["n_tokens"]): (r["n_known"], round(r["base_score"], 6), round(r["score"], 4)) for r in scoring.score(docs).collect()}
    monkeypatch.setattr(scoring, "COMMON", 0)
    b = {(r["doc_id"], r["n_tokens"]): (r["n_known"], round(r["base_score"], 6), round(r["score"], 4)) for r in scoring.score(docs).collect()}
    assert a == b


def test_model_is_normalised_and_learns():
    """A word decides on half of the words after it; probabilities of all tokens sum to one."""
    rng = np.random.default_rng(0)
    size = 300
    v = scoring.Vocabulary(np.arange(1, size + 1) * 977, [5, 9])
    x = np.zeros(60_000, np.int32)
    for k in range(1, len(x)):
        x[k] = 2 * rng.integers(0, size // 2) + (x[k - 1] % 2 == 0)
    x[::50] = v.end
    one, two = np.roll(x, 1), np.roll(x, 2)
    counts = np.bincount(x, minlength=v.tokens).astype(float)
    m = scoring.LogBilinear(v, counts)
    before = m.log10(x, one, two).mean()
    m.start(rng)
    for _ in range(3):
        for k in range(0, len(x), 1000):
            m.step(x[k : k + 1000], one[k : k + 1000], two[k : k + 1000])
    assert m.log10(x, one, two).mean() > before + 0.15
    everything = np.arange(v.tokens, dtype=np.int32)
    for a, b in ((3, 4), (v.end, v.end), (v.tokens - 1, 0)):
        assert (10 ** m.log10(everything, np.full(v.tokens, a), np.full(v.tokens, b))).sum() == pytest.approx(1, abs=1e-4)


def test_scores_equal_the_models_written_out(spark, docs):
    """Every token's group and word by the softmax itself, words beyond the vocabulary by counts of their class."""
    trained = scoring.train(docs.where("doc_id % 5 != 1 OR doc_id IS NULL").select("text"))
    m, v = trained.model, trained.model.v
    name = lambda w: scoring._signed(next(tokens.blocks(pa.array([w.decode()]))).hashes())[0]
    counts = Counter()
    for i, text, *_ in corpus():
        if i is None or i % 5 != 1:
            counts.update(words(text))
            counts[None] += 1
    assert trained.n_train == sum(counts.values()) and trained.n_distinct == len(counts)
    ranked = sorted((w for w in counts if w is not None and counts[w] > 1), key=lambda w: (-counts[w], name(w)))
    number = {w: k for k, w in enumerate(ranked)} | {None: len(ranked)}
    assert v.size == len(ranked)
    token = lambda w: number[w] if w in number else int(v.by_suffix[(w[-2] if len(w) > 1 else 0) * 256 + w[-1]])
    classes = defaultdict(list)
    for w in counts:
        if w not in number:
            classes[token(w)].append(counts[w])

    def log10(w, c):
        t = token(w)
        s = m.p["u"].astype(float) @ c + m.p["bias_u"]
        out = s[v.group_of[t]] - np.log(np.exp(s).sum())
        if t < v.size:
            a = t // scoring.GROUP * scoring.GROUP
            s = m.p["q"][a : a + scoring.GROUP].astype(float) @ c + m.p["bias_q"][a : a + scoring.GROUP]
            return (out + s[t - a] - np.log(np.exp(s).sum())) / np.log(10)
        if t == v.end:
            return out / np.log(10)
        return out / np.log(10) + np.log10((counts[w] + 0.5) / (sum(classes[t]) + 0.5 * (len(classes[t]) + 1)))

    want = Counter()
    for i, text, *_ in corpus():
        if len(text or "") > 5000:
            continue
        before, total = [None, None], 0.0
        for w in [*words(text), None]:
            one, two = (m.p["r"][token(x)].astype(float) for x in (before[-1], before[-2]))
            total += log10(w, m.p["a"].astype(float) @ one + m.p["b"].astype(float) @ two)
            before.append(w)
        want[i, round(total, 2)] += 1
    got = scoring.scored(docs.where("length(text) <= 5000 OR text IS NULL"), trained, F.lit(False)).collect()
    assert len(got) == sum(want.values())
    for r in got:
        assert any(abs(r["score"] - x) < 0.02 for i, x in want if i == r["doc_id"])


def test_scoring_beats_the_base_on_held_out_texts(spark):
    r = scoring.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert r[0] > r[1] + 0.15 * r[2]
