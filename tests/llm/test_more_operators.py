"""Filter audit, conversation trie and token counts against brute force, with nulls, empty, long, equal and clashing rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from netweft.llm import audit, counting, trie
from netweft.llm.queries import vocabulary
from netweft.llm.tokens import blocks

# -- op11 ---------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, source string, part string, mask int, n long, digest string, salt int"
LABELS = "doc_id long, quality int, toxic int, part string"


def texts():
    rng = np.random.default_rng(5)
    vocab = [f"w{k}" for k in range(300)] + ["Abc", "ÄÖ", "漢字", "#tag", "a|b"]
    out = [" ".join(rng.choice(vocab, int(rng.integers(0, 140)))) for _ in range(80)]
    out += ["same words " * 40, "A" * 200 + " b" * 60, "x" * 300_000, "", " \t\n", None, "é " * 70 + "$", " ".join(f"u{k}" for k in range(50)), " ".join(f"u{k}" for k in range(49))]
    # Exactly on the bounds: 65 of 100 words distinct, 5 of 100 characters capitals.
    out += [" ".join([f"d{k}" for k in range(65)] + ["d0"] * 35), "ABCDE" + "x" * 95]
    return out


def audit_rows():
    t = texts()
    rows = [(k, x, f"s{k % 3}") for k, x in enumerate(t)]
    rows += [(200 + k, t[k % 9], None if k % 4 else "") for k in range(40)]  # copies
    rows += [(None, t[0], "s1"), (None, t[0], "s1"), (None, "only here", "s1"), (0, t[0], "s0"), (0, t[5], "s0"), (500, "only here", "s2"), (-3, t[2], "s2")]
    return rows


def audit_labels():
    rows = [(k, k % 2, int(k % 5 == 0), "x") for k in range(0, 260, 2)] + [(k, 1, 0, "x") for k in range(1, 60, 4)]
    return rows + [(None, 1, 1, "x"), (4, 1, 1, "x"), (6, None, None, "x"), (None, 1, 1, "x")]


def audit_brute(rows, labels):
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", t)

    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(smallest.get(t or "", i), i)
    good = {i for i, q, _, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x, _ in labels if i is not None and x == 1}
    fails, parts = [], defaultdict(list)
    for i, t, s in rows:
        t = t or ""
        w = words(t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and smallest[t] < i}
        parts[s or ""].append((i, {k for k, v in f.items() if v}))
        fails.append(f)
    out = set()
    for part, docs in parts.items():
        shapley, rows_of = Counter(), []
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                earlier = [d for d in docs if f in d[1] and d[1] & set(order[: step - 1])]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                rows_of.append([part, "".join(order), step, len(left), len(gone), len(earlier), sum(d[1] == {f} for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone), f])
        out |= {(*r[:9], shapley[r[9]]) for r in rows_of}
    return out


def test_audit_equals_brute_force(spark):
    rows, labels = audit_rows(), audit_labels()
    docs = spark.createDataFrame([(i, t, s, "p", 3, 9, "d", 1) for i, t, s in rows], DOCS).repartition(4)
    got = audit.audit(docs, spark.createDataFrame(labels, LABELS))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == 600 * 4 and set(found) == audit_brute(rows, labels)
    assert audit.audit(docs.where("doc_id = -99"), spark.createDataFrame(labels, LABELS)).count() == 0
    assert audit.audit(docs, spark.createDataFrame([], LABELS)).where("good_lost + toxic_lost > 0").count() == 0


def test_audit_counts_distinct_words_where_hashes_collide():
    some = ["a bb a ccc bb", "", "x y z", "same same same", "q" * 5000 + " " + "q" * 5000 + " " + "q" * 4999 + "r"]
    block = next(blocks(pa.array(some), lower=False))
    want = [len(set(t.split())) for t in some]
    assert audit._distinct(block).tolist() == want
    assert audit._distinct(block, np.zeros(len(block.start), np.uint64)).tolist() == want  # all words of one hash
    few = np.arange(len(block.start), dtype=np.uint64) % np.uint64(2)
    repeated = block.hashes()
    repeated[:2] = few[0]
    assert audit._distinct(block, np.sort(repeated) * np.uint64(0) + np.uint64(7)).tolist() == want


# -- op12 ---------------------------------------------------------------------------------------------

CONVERSATIONS = "conv_id long, turn long, role string, text string, c string, d int, key string"


def conversations():
    rng = np.random.default_rng(9)
    rows = []
    for c in range(60):
        for t in range(int(rng.integers(0, 12))):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"text {int(rng.integers(0, 2))} {t}" + "é" * int(rng.integers(0, 2))))
    for c in range(100, 140):  # equal conversations
        rows += [(c, t, "user", f"shared {t}") for t in range(10)]
    for c in range(200, 212):  # long ones that part at various depths, some beyond a segment
        stop = 40 + 20 * (c - 200)
        rows += [(c, t, "user", f"long {t}" if t < stop else f"own {c} {t}") for t in range(270)]
    rows += [(205 + 5 * k, t, "user", f"long {t}") for k in range(4, 7) for t in range(64 + k)]
    rows += [(300, None, None, None), (300, 2, "", ""), (300, 1, "user", None), (300, 1, "user", None), (301, 0, "user", "x"), (301, 0, "user", "x"), (-7, 0, "user", "minus"), (-5, 0, "a", "b"), (-5, 1, "a", "b"), (None, 0, "user", "nobody"), (400, 5, "user", "z" * 100_000)]
    return rows


def digest(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def trie_brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role, text), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        value = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += value
            leaves[p[:d]] += children[p] == 0
    out = set()
    for p, m in members.items():
        ends = sorted(c for c in m if len(built[c]) == len(p))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("partitions", [1, 5])
def test_trie_equals_brute_force(spark, partitions):
    rows = conversations()
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], CONVERSATIONS).repartition(partitions)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(3 * partitions))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # nodes on many partitions
        got = trie.nodes(trie.rebuilt(table))
        found = [tuple(r) for r in got.collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    want = trie_brute(rows)
    assert len(found) == len(want) and set(found) == want


def test_trie_of_few_rows(spark):
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert trie.nodes(trie.rebuilt(empty)).count() == 0
    for rows in ([(None, 1, "user", "x")], [(1, 0, "user", "x")], [(8, 0, "user", "x"), (8, 1, "user", "y")]):
        table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], CONVERSATIONS)
        assert {tuple(r) for r in trie.nodes(trie.rebuilt(table)).collect()} == trie_brute(rows) - ({x for x in trie_brute(rows)} if rows[0][0] is None else set())


def test_ids_of_a_node_in_chunks(spark):
    ids = [3, -2, 10**12, *range(20_000, 40_000, 2)]
    ends = spark.createDataFrame([((0, 1, 2), c) for c in ids] + [((1, 1, 2), 5)], "key struct<depth:long,k1:long,k2:long>, c long").repartition(3)
    got = {r["key"]["depth"]: r["ends_sha256"] for r in trie._digests(ends).collect()}
    assert got == {0: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), 1: hashlib.sha256(b"5").hexdigest()}


# -- op13 ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


def token_texts():
    rng = np.random.default_rng(2)
    marks = [chr(c) for c in rng.integers(0x20, 0x2FFFF, 4000) if not 0xD800 <= c <= 0xDFFF]
    out = ["", " ", "\n\n  \t x", "it's we'll I'M they'VE", "hello <|endoftext|> world", "<|endoftext|>" * 3, "x<|endoftext|", "a" * 3000, " " * 70_000 + "y", "é漢字 😀 ٣٤", "՘࢏ new", "tab\tand blank　wide"]
    out += ["".join(rng.choice(marks, 50)) for _ in range(40)]
    return out + [" ".join(rng.choice(["the", "model", "Größe", "1234", "don't", "—", "x_y"], 300)) for _ in range(10)]


def test_counts_are_the_librarys(spark, library):
    rows = [(k, t) for k, t in enumerate(token_texts())] + [(None, "no id"), (3, None), (3, "it's"), (3, "it's")]
    docs = spark.createDataFrame([(i, t, 9, True) for i, t in rows], "doc_id long, text string, n_tokens int, over_limit boolean").repartition(3)
    got = Counter(tuple(r) for r in counting.count(docs, vocabulary()).collect())
    n = [(i, t or "", len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert got == Counter((i, len(t.encode()), k, k > 512) for i, t, k in n)
    assert counting.count(docs.where("doc_id > 9999"), vocabulary()).count() == 0


def test_all_characters_split_as_in_the_library(library):
    """Every character between letters, digits, marks and blanks, in runs that hold many of them."""
    tokens = counting.WholeTokens(vocabulary())
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    settled = [c for c in every if not counting.unsettled(c)]
    assert len(settled) > 250_000
    for some in (settled[k : k + 2000] for k in range(0, len(settled), 2000)):
        text = " \n".join(f"a{c}b1{c}2.{c}, {c}{c}x" for c in some)
        assert [m.span() for m in tokens.split.finditer(text)] == [s for _, s in library.pre_tokenizer.pre_tokenize_str(text)]


def test_windows_and_proof(library):
    tokens = counting.WholeTokens(vocabulary())
    assert len(tokens.whole) > 45_000
    long = "word  two\n\nthree 's " * 60_000 + " " * 2_000_000 + "end " * 300_000
    assert len(long) > 3 * counting.WINDOW
    assert tokens.ordinary(long) == len(library.encode(long, add_special_tokens=False).ids)
    # A vocabulary whose merges overtake a string: it is no whole token.
    assert " the" in tokens.whole and "qqqqq" not in tokens.whole


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_files_are_counted_by_their_library(file):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path(file)
    tokens = counting.WholeTokens(path)
    for t in ("Hello World, it's 3 o'clock", "  two  blanks ", "é漢字", ""):
        want = len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t)) if file.endswith(".model") else len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids)
        assert tokens(t) == want
