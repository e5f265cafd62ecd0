"""Operators against plain programs that follow their rules row by row, and rows at the edges."""

import bz2
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from netweft.llm import classifier, jaccard, matroska, mixing, packing, rules, scoring, sharding, tokens, warc
from netweft.llm.queries import vocabulary

from test_operators import corpus, docs, links_brute, make, words  # noqa: F401


def opposite_words(n):
    """Two words of n letters that differ everywhere and balance in every polynomial of low order."""
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


# -- words and sets ---------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 8, 16, 1024, 4096, 1 << 15])
def test_long_words_have_hashes_of_their_own(n):
    a, b = opposite_words(n)
    h = next(tokens.blocks(pa.array([f"{a} {b} {a}x {a[1:]}"]))).hashes()
    assert len(set(h.tolist())) == (4 if n > 1 else 3)


def test_long_words_in_joins_and_counts(spark):
    a, b = opposite_words(1024)
    train = next(i for i in range(10, 99) if zlib.crc32(str(i).encode()) % 5 != 1)
    held = next(i for i in range(10, 99) if zlib.crc32(str(i).encode()) % 5 == 1)
    df = make(spark, [(train, a), (held, b)])
    assert {r["doc_id"]: r["component_id"] for r in jaccard.join(df).collect()} == {train: train, held: held}
    assert {r["doc_id"]: r["n_known"] for r in scoring.score(df).collect()} == {train: 2, held: 1}


def test_sets_of_one_name_stay_apart(spark, docs, monkeypatch):  # noqa: F811
    """With names of six bits most sets share theirs and go by their second one."""
    monkeypatch.setattr(jaccard, "NAME_BITS", 6)
    got = jaccard.join(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["n_links"]) for r in got) == links_brute(corpus())


def test_one_row_of_each_component_is_kept(spark, docs):  # noqa: F811
    rows = docs.unionByName(docs.where("doc_id IN (3, 7, 200)"))
    got = Counter((r["doc_id"], r["text"]) for r in jaccard.keep(rows).collect())
    joined = jaccard.join(rows).where("n_shingles > 0").select("component_id").distinct().count()
    none = [(i, t) for i, t, *_ in corpus() if not words(t)]
    assert sum(got.values()) == joined + len(none) + 1  # the text without words that stands twice stays twice
    assert got[3, corpus()[3][1]] == 1 and got[7, corpus()[7][1]] == 1 and got[200, None] == 2
    assert jaccard.keep(rows).columns == rows.columns


# -- media columns ------------------------------------------------------------------------------------


def test_packets_meet_their_cues(spark):
    media = matroska.store(make(spark, [(k, "sound " * (k * 4000)) for k in range(6)] + [(None, None)]))
    found, index = matroska.packets(media), matroska.cues(media)
    first = found.groupBy("doc_id", "cluster").agg(F.min("timestamp").alias("time"))
    joined = first.join(index.withColumnRenamed("time", "cued"), (F.col("cluster") == F.col("position")) & first["doc_id"].eqNullSafe(index["doc_id"]))
    assert joined.count() == index.count() == first.count() > 7
    assert joined.where("time != cued").count() == 0
    assert matroska.packets(media.where("doc_id > 99")).count() == matroska.cues(media.where("doc_id > 99")).count() == matroska.features(media.where("doc_id > 99")).count() == 0


@pytest.mark.parametrize("stated,want", [("nothing", [105, None, None, 107]), ("frame", [105, 115, 125, 107]), ("sound", [105, 108, 108, 107]), ("block", [105, 111, 117, 107])])
def test_times_of_laced_frames(stated, want):
    M = matroska
    sizes = [300, 10, 700]
    block = b"\x81\x00\x05" + bytes([3 << 1]) + M._lace(sizes, 3) + bytes(sum(sizes))
    body = M._element(M.BLOCK_GROUP, M._element(M.BLOCK, block) + M._uint(M.BLOCK_DURATION, 18)) if stated == "block" else M._element(M.SIMPLE_BLOCK, block)
    other = M._element(M.BLOCK_GROUP, M._element(M.BLOCK, b"\x82\x00\x07\x00abc") + M._element(M.REFERENCE_BLOCK, b"\x01"))
    entry = M._uint(M.TRACK_NUMBER, 1) + (M._uint(M.DEFAULT_DURATION, 5_000_000) if stated == "frame" else b"")
    if stated == "sound":  # 200 bytes a tick of half a millisecond
        entry += M._element(M.CODEC_ID, b"A_PCM/INT/LIT") + M._element(M.AUDIO, M._float(M.SAMPLING_FREQUENCY, 100_000.0) + M._uint(M.CHANNELS, 2) + M._uint(M.BIT_DEPTH, 8))
    head = M._element(M.INFO, M._uint(M.TIMESTAMP_SCALE, 500_000)) + M._element(M.TRACKS, M._element(M.TRACK_ENTRY, entry))
    file = M._element(M.EBML, b"") + M._element(M.SEGMENT, head + M._element(M.CLUSTER, M._uint(M.TIMESTAMP, 100) + body + other))
    found, _, _ = M.demux(file)
    assert [p.timestamp for p in found] == want
    assert [p.keyframe for p in found][-1] is False
    assert file[found[0].cluster : found[0].cluster + 4] == bytes.fromhex("1F43B675")


def _file(track: bytes, frames: list[bytes]) -> bytes:
    M = matroska
    blocks = b"".join(M._element(M.SIMPLE_BLOCK, b"\x81\x00\x00\x80" + x) for x in frames)
    head = M._element(M.TRACKS, M._element(M.TRACK_ENTRY, M._uint(M.TRACK_NUMBER, 1) + track))
    return M._element(M.EBML, b"") + M._element(M.SEGMENT, head + M._element(M.CLUSTER, M._uint(M.TIMESTAMP, 0) + blocks))


def _encoding(algorithm: int, settings: bytes = b"", order: int = 0, scope: int = 1, kind: int = 0) -> bytes:
    M = matroska
    inner = M._element(M.COMPRESSION, M._uint(M.COMPRESSION_ALGORITHM, algorithm) + M._element(M.COMPRESSION_SETTINGS, settings))
    return M._element(M.CONTENT_ENCODING, M._uint(M.ENCODING_ORDER, order) + M._uint(M.ENCODING_SCOPE, scope) + M._uint(M.ENCODING_TYPE, kind) + inner)


def test_content_encodings_are_undone(spark):
    M, plain = matroska, [b"head one", b"head two " * 50, b"head "]
    all_of = lambda *x: M._element(M.CONTENT_ENCODINGS, b"".join(x))
    files = {
        0: _file(b"", plain),
        1: _file(all_of(_encoding(0)), [zlib.compress(x) for x in plain]),
        2: _file(all_of(_encoding(1)), [bz2.compress(x) for x in plain]),
        3: _file(all_of(_encoding(3, b"head ")), [x[5:] for x in plain]),
        4: _file(all_of(_encoding(3, b"head ", 0), _encoding(0, order=1)), [zlib.compress(x[5:]) for x in plain]),
        5: _file(all_of(_encoding(0, scope=2)), plain),  # of the track's private data only
        6: _file(all_of(_encoding(0)), plain),  # not what the track says
        7: _file(all_of(_encoding(2)), plain),
        8: _file(all_of(_encoding(0, kind=1)), plain),
        9: _file(M._element(M.CONTENT_ENCODINGS, M._element(M.CONTENT_ENCODING, b"")), [zlib.compress(x) for x in plain]),  # defaults
    }
    media = spark.createDataFrame([(k, 0, bytearray(m)) for k, m in files.items()], "doc_id long, n_bytes long, media binary")
    got = defaultdict(list)
    for r in matroska.frames(media).orderBy("doc_id", "packet").collect():
        got[r["doc_id"]].append(bytes(r["frame"]))
    assert dict(got) == dict.fromkeys((0, 1, 2, 3, 4, 5, 9), plain)
    assert {r["doc_id"] for r in matroska.faults(media).collect()} == {6, 7, 8}
    assert {r["doc_id"] for r in matroska.packets(media).where("encoded").collect()} == {1, 2, 3, 4, 6, 7, 8, 9}
    digests = {r["doc_id"]: r["payload_sha256"] for r in matroska.features(media).collect()}
    assert {k for k, x in digests.items() if x == hashlib.sha256(b"".join(plain)).hexdigest()} == {0, 1, 2, 3, 4, 5, 9} and digests[6] is None


def test_faulty_files_fail_no_job(spark):
    whole = matroska.mux(bytes(range(64)) * 40)
    rng = np.random.default_rng(5)
    bad = [whole[:k] for k in range(0, len(whole), 7)] + [rng.bytes(int(n)) for n in rng.integers(1, 300, 50)]
    for k in rng.integers(0, len(whole), 200).tolist():  # a damaged byte may do no harm, but raises nothing
        bad.append(whole[:k] + bytes([whole[k] ^ 0xFF]) + whole[k + 1 :])
    rows = [(-1, 1, bytearray(whole)), (-2, 1, None), *((k, 1, bytearray(m)) for k, m in enumerate(bad))]
    media = spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")
    faulty = {r["doc_id"]: r["fault"] for r in matroska.faults(media).collect()}
    cut_off = {k for k in range(0, -(-len(whole) // 7)) if bad[k] != whole}
    # Where the header's element alone is left, the file is well-formed and holds nothing.
    assert {k for k in cut_off if k not in faulty} <= {k for k in cut_off if not matroska.attempt(bad[k])[0]} and len(cut_off - set(faulty)) <= 1
    assert -1 not in faulty and -2 not in faulty and all(faulty.values())
    assert {r["doc_id"] for r in matroska.packets(media).select("doc_id").distinct().collect()}.isdisjoint(faulty)
    assert matroska.cues(media).where("doc_id = -1").count() == 1 and matroska.packets(media).where("doc_id = -1").count() == 5
    given = {r["doc_id"]: r for r in matroska.features(media.where("media IS NOT NULL")).collect()}
    assert len(given) == len(rows) - 1 and all(given[k]["payload_sha256"] is None and given[k]["media_bytes"] == len(bad[k]) for k in faulty)


def test_features_written_out(spark):
    texts = ["", None, "abc", "é" * 1000, "long " * 300_000]
    media = matroska.store(make(spark, list(enumerate(texts))))
    stored = {r["doc_id"]: bytes(r["media"]) for r in media.collect()}
    for r in matroska.features(media).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\0" * (64 - len(raw) if len(raw) < 64 else -len(raw) % 64)
        m = stored[r["doc_id"]]
        assert (r["media_bytes"], r["media_sha256"]) == (len(m), hashlib.sha256(m).hexdigest())
        said = dict(x.split("=") for x in r["feature"].split(";"))
        x = list(payload)
        mean = sum(x) / len(x)
        assert int(said["packets"]) == -(-len(payload) // 512) and int(said["clusters"]) == int(said["cues"]) == -(-len(payload) // 65536)
        assert (int(said["peak"]), int(said["zero"]), int(said["ticks"])) == (max(x), x.count(0), len(x) // 64)
        assert float(said["mean"]) == pytest.approx(mean, abs=1e-4)
        assert float(said["deviation"]) == pytest.approx((sum((v - mean) ** 2 for v in x) / len(x)) ** 0.5, abs=1e-3)
        assert float(said["step"]) == pytest.approx(sum(abs(a - b) for a, b in zip(x, x[1:])) / (len(x) - 1), abs=1e-3)


# -- ring ---------------------------------------------------------------------------------------------


def test_ring_walk_row_by_row(spark):
    """Every row walks clockwise from its arc to the first point whose shard has room, classes in order, arcs in order, rows by id."""
    rows = corpus() + [(900, "same")] * 60 + [(901, None)] * 30
    df = make(spark, rows)
    keyed = df.select(
        "doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"), (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long").alias("bytes"),
        F.pmod(F.xxhash64(F.lit(sharding.SEED), F.col("doc_id").cast("long")), F.lit(1 << 31)).alias("position"),
    ).withColumn("level", F.pmod(F.xxhash64("crc", F.col("doc_id").cast("long"), "bytes"), F.lit(sharding.CLASSES)))
    points = sharding.ring(5, 16)
    arc = lambda p: next((k for k, (x, _) in enumerate(points) if x >= p), 0)
    order = list(dict.fromkeys(s for _, s in points))
    room = {s: len(rows) // 5 + (k < len(rows) % 5) for k, s in enumerate(order)}
    want, slots = Counter(), defaultdict(int)
    for r in sorted(keyed.collect(), key=lambda r: (r["level"], arc(r["position"]), r["doc_id"] is not None, r["doc_id"] or 0, r["crc"], r["bytes"])):
        k = arc(r["position"])
        while not room[points[k][1]]:
            k = (k + 1) % len(points)
        s = points[k][1]
        room[s] -= 1
        want[r["doc_id"], r["crc"], s, slots[s]] += 1
        slots[s] += 1
    got = Counter((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shard(df, 5, 16).collect())
    assert got == want


# -- classifier -----------------------------------------------------------------------------------------


def test_classifier_written_out(spark, sf):
    """The same scores from all rows at once: moments, normal equations of both folds, pooled curve."""
    df = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = df.select("doc_id", "text").collect()
    x = np.vstack([classifier.statistics_of(pa.array([r["text"]], pa.string())) for r in rows])
    f = classifier.Features(x.mean(0), x.std(0))(x)
    rest = np.array([zlib.crc32(str(r["doc_id"]).encode()) % 3 for r in rows])
    y = np.array([labels.get(r["doc_id"], -1) for r in rows], float)
    use, fold = (y >= 0) & (rest != 1), (rest == 2).astype(int)

    def ridge(m):
        return np.linalg.solve(f[m].T @ f[m] + classifier.RIDGE * m.sum() * np.eye(f.shape[1]), f[m].T @ y[m])

    other = [ridge(use & (fold != k)) for k in range(2)]
    s = np.where(fold == 1, f @ other[1], f @ other[0])[use]
    b = np.clip((s + 1) / 3 * classifier.BINS, 0, classifier.BINS - 1).astype(int)
    pools = [[(k + 0.5) * 3 / classifier.BINS - 1, y[use][b == k].mean(), float((b == k).sum())] for k in np.unique(b)]
    while (bad := next((k for k in range(len(pools) - 1) if pools[k][1] >= pools[k + 1][1]), None)) is not None:
        p, q = pools[bad], pools.pop(bad + 1)
        w = p[2] + q[2]
        pools[bad] = [(p[0] * p[2] + q[0] * q[2]) / w, (p[1] * p[2] + q[1] * q[2]) / w, w]
    want = np.clip(np.interp(f @ ridge(use), [p[0] for p in pools], [p[1] for p in pools]), 0, 1)
    got = {r["doc_id"]: r for r in classifier.classify(df, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    for r, w in zip(rows, want):
        assert got[r["doc_id"]]["score"] == pytest.approx(w, abs=1e-6)
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_statistics_written_out():
    text = "The the  Cat, cat | sat!\nThe the  Cat, cat | sat!\n\nÄ 12 of of\n"
    got = dict(zip(classifier.STATISTICS, classifier.statistics_of(pa.array([text, None, " \n"]))[0]))
    w, raw = text.split(), text.encode()
    sizes = [len(x.encode()) for x in w]
    assert got["log_words"] == pytest.approx(np.log1p(len(w))) and got["log_bytes"] == pytest.approx(np.log1p(len(raw)))
    assert got["word_bytes"] == pytest.approx(np.mean(sizes)) and got["word_bytes_deviation"] == pytest.approx(np.std(sizes))
    assert got["bars"] == pytest.approx(2 / len(w)) and got["exclamations"] == pytest.approx(2 / len(w)) and got["digits"] == pytest.approx(2 / len(raw))
    assert got["capitals"] == pytest.approx(4 / len(raw)) and got["other_scripts"] == pytest.approx(2 / len(raw)) and got["repeated_lines"] == pytest.approx(1 / 3)
    lower = [x.lower() for x in w]
    assert got["word_after_itself"] == pytest.approx(sum(a == b for a, b in zip(lower, lower[1:])) / len(w))
    assert got["commonest_word"] == pytest.approx(max(Counter(lower).values()) / len(w))
    assert got["punctuation"] == pytest.approx(2 / len(w)) and got["symbols"] == pytest.approx(2 / len(raw))
    assert got["distinct_words"] == pytest.approx(len(set(lower)) / len(w) ** 0.9)
    assert got["words_per_line"] == pytest.approx(np.log1p(len(w) / 3))
    windows = [tuple(lower[k : k + 8]) for k in range(len(w) - 7)]
    assert got["repeated_windows"] == pytest.approx(1 - len(set(windows)) / len(windows))
    assert got["stop_words"] == pytest.approx(sum(x in rules.ALL_STOP_WORDS for x in lower) / len(w)) and got["stop_words"] > 0
    twice = "a b c d e f g h " * 3
    assert classifier.statistics_of(pa.array([twice]))[0][classifier.STATISTICS.index("repeated_windows")] == pytest.approx(1 - 8 / 17)


# -- pipeline ---------------------------------------------------------------------------------------------


def test_stages_at_the_edges(spark, sf):
    """Nulls in every column, empty and repeated rows, clashing columns, an empty table; decisions by row."""
    good = " ".join(f"word{k % 37} of the text{k}" for k in range(60))
    rows = [(1, good, "en", "a", 1), (1, good, "en", "a", 1), (1, "x", None, "a", None), (None, good + " more", None, None, None), (None, None, None, None, None), (2, "", "en", "b", 0), (3, good.replace("text7", "other"), "en", None, 5)]
    df = spark.createDataFrame([(*r, 7, "clash", True) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row int, size string, is_first boolean")
    keyed = lambda d: Counter((r["doc_id"], r["text"]) for r in d.collect())
    for name, stage in P.STAGES[:4]:
        out = stage(spark, df, sf)
        assert tuple(out.columns) == P.COLUMNS, name
        assert stage(spark, df.where("doc_id > 9"), sf).count() == 0, name
        if name != "mix_sources":
            assert not keyed(out) - keyed(df), name
        if name == "quality_rules":
            assert keyed(out) == Counter({(i, t): n for (i, t), n in keyed(df).items() if t and len(t) > 9})
        if name == "near_duplicates":  # one of the four alike; the texts without words and the short one stay
            assert keyed(out) == Counter({(1, good): 1, (1, "x"): 1, (None, None): 1, (2, ""): 1})
        if name == "mix_sources":
            want = Counter()
            for r in mixing.mix(df).collect():
                want[r["doc_id"], r["size"]] += r["repeats"]
            assert Counter((r["doc_id"], len(words(r["text"]))) for r in out.collect()) == +want
    packed = P.STAGES[4][1](spark, df, sf)
    assert packed.count() == packing.pieces(df, vocabulary()).count() == len(rows)
    assert P.STAGES[4][1](spark, df.where("doc_id > 9"), sf).count() == 0


def test_archive_of_clashing_columns_null_ids_and_copies(spark):
    rows = [(1, "a", "x"), (2, "b", "x"), (2, "b", "x"), (3, None, None), (4, "d", ""), (None, "e", "x"), (None, "f", "alone"), (None, "g", "both"), (None, "g", "both"), (5, "h", "w" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "7 AS last", "8 AS first", "9 AS rows", "'k' AS key", "1 AS n")
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.records(warc.write(pages)).collect())
    assert got == Counter({
        (2, 1, "response", None): 1, (2, 1, "revisit", 2): 1, (1, 1, "revisit", 2): 1, (None, 1, "revisit", 2): 1, (4, 0, "response", None): 1, (3, 0, "revisit", 4): 1,
        (None, 5, "response", None): 1, (None, 4, "response", None): 1, (None, 4, "revisit", None): 1, (5, 3_000_000, "response", None): 1,
    })


def test_ring_of_equal_rows(spark):
    docs = spark.range(1000).selectExpr("7L AS doc_id", "'same' AS text", "0 AS arc", "1 AS level", "2 AS runs")
    got = sharding.shard(docs).collect()
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == 1000 and {len(s) for s in slots.values()} <= {41, 42}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 8])
def test_repeated_windows_of_any_length(spark, n):
    texts = ["a b a b a b c", "x " * 20, "p q r s t u v w " * 3 + "z", "one two three four five six seven eight nine", ""]

    def brute(w):
        seen = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        return len({i + k for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for k in range(n)})

    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", rules.repeat_words(rules.words(F.col("text")), n).alias("c")).collect()
    assert [r["c"] for r in rows] == [brute(r["text"].split()) for r in rows]
