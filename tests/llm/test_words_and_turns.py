"""Spelling variants, the prefix trie and the piece vocabulary against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from boxwright.llm import oracles, prefix_trie, queries, sentence_pieces, spelling

LOWER = {k: k + 32 for k in range(65, 91)}


def plain_variants(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    n = {w: c for w, c in count.items() if c >= 2}
    near = {w: [v for v in n if v != w and one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        if others and n[best := min(others, key=lambda v: (-n[v], v))] >= 10 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def told(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_spelling_variants(spark):
    r = random.Random(3)
    base = ["letters", "lettters", "aabbccdd", "éàüßöñç", "abcdefgh", "mississippi"]
    rows = []
    for i in range(300):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 0, 0, 1, 2])):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randint(0, 1)] = r.choice(["", "a", "é", "÷", "t"])
        word = "".join(w)
        rows.append((i, f"{word}, {word.upper()}9{word} " * r.choice([1, 1, 5, 40])))
    rows += [(300, None), (301, ""), (None, "letters lettars"), (302, "x" * 70_000 + " letters"), (302, "x" * 70_000), (5, rows[5][1]), (303, "日本 letters▁letters ÀÉÎÀÉÎÀÉ àéîàéîàé " * 30)]
    rows += [(400 + k, "chainaa " * 2 + "chainab " * 30 + "chainbb " * 400) for k in range(5)]
    long = "abcdefgh" * 8
    rows += [(500 + k, f"{w} " * n) for k, (w, n) in enumerate([(long[:63], 2), (long, 30), (long + "i", 2), (long + "ij", 30), (long + "ik", 30), (long + "i" * 9, 3), ("b" + long[1:] + "i" * 9, 40), (long + "z" + "i" * 8, 40), (long + "i" * 8, 2)])]
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id bigint, text string, word string, n int").repartition(3)
    want = plain_variants(rows)
    assert told(spelling.variants(docs)) == want and len(want) > 60 and sum(f is not None for f, *_ in want.values()) > 20
    assert sum(x[3] > 0 and len(w) > 64 for w, x in want.items()) >= 6
    assert any(x[0] and x[1] != x[0] for x in want.values())
    assert spelling.variants(docs.limit(0)).count() == 0


def test_roots_follow_long_ways(spark):
    links = [(f"w{k:02}", f"w{k + 1:02}") for k in range(18)]
    assert {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(links, "word string, form string")).collect()} == {w: "w18" for w, _ in links}


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    own = {c: [(role, text) for _, role, _, text in sorted(t)] for c, t in own.items()}
    members = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        members[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    nodes = defaultdict(list)
    for c, t in members.items():
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].append(c)
    leaves, saved, children = Counter(), Counter(), Counter()
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    for p, m in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    ends = lambda p, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(members[c]) == len(p)))).encode()).hexdigest()
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], ends(p, m)) for p, m in nodes.items())


def turns_of(seed=1, n=140):
    r = random.Random(seed)
    say = lambda: (r.choice(["user", "assistant"]), r.choice(["a", "bb", "é日", "", None, "long " * 400]))
    rows, opening = [], [say() for _ in range(12)]
    for c in range(n):
        k = r.choice([1, 2, 5, 9, 20])
        t = (opening + [say() for _ in range(9)])[:k] if r.random() < 0.5 else [say() for _ in range(k)]
        rows += [(c, i, *x) for i, x in enumerate(t)]
    rows += [(c, i, *x) for c in range(n, n + 30) for i, x in enumerate(opening)]  # copies
    rows += [(7, None, "system", "s"), (7, None, None, None), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (None, 1, "user", "x"), (900, 1, "user", "x"), (902, None, None, None), (2007, 1, "user", "alone")]
    r.shuffle(rows)
    return rows


TURNS = "conv_id bigint, turn bigint, role string, text string"


def nodes_of(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


@pytest.mark.parametrize("small,stride", [(256, 64), (0, 64), (20, 2), (1000, 3)])
def test_prefix_trie(spark, small, stride):
    rows = turns_of()
    df = spark.createDataFrame(rows, TURNS).withColumns({"pos": F.lit("clash"), "id": F.lit(1)}).repartition(5)
    assert nodes_of(prefix_trie.conversation_trie(df, small, stride)) == plain_trie(rows)


def test_prefix_trie_of_little(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    for rows in ([(3, 1, "user", "x")], [(0, 1, "user", "x"), (0, 2, "user", "y")], [(None, 1, "user", "x"), (5, None, None, None)]):
        assert nodes_of(prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS))) == plain_trie(rows)


def test_a_long_conversation_is_numbered_over_tasks(spark):
    rows = [(1, k, "user", str(k % 7)) for k in range(6000)] + [(2, k, "user", str(k)) for k in range(5)]
    got = prefix_trie.numbered(spark.createDataFrame(rows, TURNS).repartition(6)).where("conv = 1").orderBy("pos").select("pos", "dig").collect()
    digest = [hashlib.sha256(f"4:user{k % 7}".encode()).digest() for k in range(6000)]
    assert [r["pos"] for r in got] == list(range(1, 6001)) and [bytes(r["dig"]) for r in got] == digest


def test_oracles_hold_too(spark):
    """The SQL agrees with the plain versions where those are awkward."""
    rows = [r for r in turns_of(4, 60) if r[0] is not None]
    con = duckdb.connect()
    con.register("conversations", spark.createDataFrame(rows, TURNS).toArrow())
    got = con.sql(oracles.OP12).fetchall()
    assert sorted(tuple(-1 if v is None else v for v in r) for r in got) == plain_trie(rows)


AWKWARD = ["", " ", "  two  spaces ", "▁▁x ▁", "<s>a</s><0x0A>", "tab\tnew\nline\r\x00", "日本語 \U0001f600 ￿ é", " " * 500 + "a", "a" * 3000, "Ünïcødé " * 300, "a b​c"]


def awkward_texts(seed=2, n=400):
    r = random.Random(seed)
    return AWKWARD + ["".join(r.choice(" ▁abtheein.,\n\tÀé日\U0001f600<s>0x") for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_pieces_equal_the_library(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(awkward_texts() + [None])], "doc_id bigint, text string").repartition(4)
    assert sentence_pieces.differences(docs, queries.pieces_path()).count() == 0
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sentence_pieces.differences(given, queries.pieces_path()).count() == 0


def test_pieces_columns(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.pieces_path())
    texts = [*AWKWARD, None, "x y", "x y"]
    docs = spark.createDataFrame([(t, "kept", i) for i, t in enumerate(texts)], "text string, decoded string, pos int")
    rows = sentence_pieces.decode(sentence_pieces.encode(docs, queries.pieces_path()), queries.pieces_path(), out="said").orderBy("pos").collect()
    assert [r["ids"] for r in rows] == [library.encode(t or "", add_eos=True) for t in texts]
    assert [r["said"] for r in rows] == [library.decode(r["ids"]) for r in rows] and all(r["decoded"] == "kept" for r in rows)
    with pytest.raises(ValueError):
        sentence_pieces.decode(sentence_pieces.encode(docs, queries.pieces_path()), queries.pieces_path())
    assert sentence_pieces.encode(docs.limit(0), queries.pieces_path()).count() == 0


def test_decoding_of_any_ids():
    import sentencepiece

    with open(queries.pieces_path(), "rb") as f:
        model = f.read()
    own, library, r = sentence_pieces.Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model), random.Random(5)
    for _ in range(3000):
        ids = [r.choice([0, 1, 2, r.randrange(3, 259), r.randrange(3, 259), r.randrange(259, 275), r.randrange(32000)]) for _ in range(r.randint(0, 9))]
        assert own.decode(ids) == library.decode(ids), ids


def test_pieces_remembered_or_not(monkeypatch):
    with open(queries.pieces_path(), "rb") as f:
        model = f.read()
    texts = awkward_texts(6, 100)
    whole = [list(sentence_pieces.Pieces(model).encode(t)) for t in texts]
    monkeypatch.setattr(sentence_pieces, "REMEMBERED", 3)
    few = sentence_pieces.Pieces(model)
    assert [list(few.encode(t)) for t in texts] == whole
