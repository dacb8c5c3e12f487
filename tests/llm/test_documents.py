import random
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boxwright.llm import common, decontamination, line_dedup, near_dedup, packing, passages, quality_rules, sharding, substring_exact
from boxwright.llm.queries import tokenizer_path
from tests.llm import reference

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, rank int"


def corpus(seed=5, n=60):
    """Prose with exact and near copies, shared passages and lines, junk, and the awkward cases."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeioulnrstéß") for _ in range(r.randint(1, 9))) for _ in range(400)]
    prose = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, line = prose(70), prose(9)
    texts = []
    for i in range(n):
        t = prose(r.choice([3, 12, 60, 150]))
        if i % 6 == 0:
            t = t + " " + passage + " " + prose(30)
        if i % 4 == 0:
            t = t + "\n" + line + "\n" + prose(5)
        texts.append(t)
    base = prose(160).split()
    for _ in range(25):  # a group of near copies, some only linked through others
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [texts[0]] * 4 + [None, "", " \t\n", "One two", "ONE  two", "a b c d", "same words " * 40, "x" * 5000, "\n".join([line] * 3), prose(3000), "\x00nul \x01 bytes 日本語 \U0001f600 " * 12]
    rows = [(i, t, "en", f"s{i % 13}" if i % 17 else None, None if t is None else len(t), "clash", 1) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_counts(docs, rows, none):
    got = {r["doc_id"]: r["quality"] for r in quality_rules.quality_rules(docs).collect()}
    for i, text, *_ in rows:
        q = got[i]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"], q["base_failed"]) == reference.quality_base(text), text
        assert not (q["base_failed"] and q["kept"])
    assert quality_rules.quality_rules(none).count() == 0


def test_quality_plan_is_native(docs):
    plan = quality_rules.quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_quality_rules_reject_junk(spark):
    prose = "the old house of the town was by the river and it had many small rooms for all that came to it"
    junk = " ".join(w + "###" for w in prose.split())
    loud = " ".join(w.upper() + "!!" for w in prose.split())
    df = spark.createDataFrame([(1, prose), (2, junk), (3, loud)], "doc_id bigint, text string")
    assert {r["doc_id"]: r["quality"]["kept"] for r in quality_rules.quality_rules(df).collect()} == {1: True, 2: False, 3: False}


def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer_path())
    pieces = packing.pack(docs, tokenizer_path(), length=256, grid=4).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == {r[0] for r in rows}
    for i, text, *_ in rows:
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            part = ids[p["start"] : p["start"] + p["length"]]
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            at += p["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 256
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_cutting_stock_is_near_the_bound():
    import numpy as np

    r = np.random.default_rng(2)
    size, demand = np.unique(r.integers(1, 65, 4000), return_counts=True)
    plan = packing.cutting_stock(size, demand, 64)
    assert (sum(p * n for p, n in plan) == demand).all() and all((p * size).sum() <= 64 for p, _ in plan)
    assert sum(n for _, n in plan) <= 1.01 * (size * demand).sum() / 64 + 2


def test_sharding(spark, docs, rows, none, tmp_path):
    path = f"file://{tmp_path}/map"
    got = sharding.shard_by_bytes(docs, 8, map_path=path).collect()
    assert sorted(r["doc_id"] for r in got) == [r[0] for r in rows]
    size = {i: len((t or "").encode()) + 1 for i, t, *_ in rows}
    places, load = defaultdict(list), defaultdict(int)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["text_crc32"] == zlib.crc32((rows[r["doc_id"]][1] or "").encode())
        places[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(load.values()) <= max(max(size.values()), 1.05 * sum(size.values()) / 8)
    assert sharding.read_map(spark, path, 0).count() == sharding.read_map(spark, path, 1).count() == sharding.N_SLOTS
    assert sharding.shard_by_bytes(none, 8).count() == 0


def test_exact_substrings(spark, docs, rows, none):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_exact.remove_repeats(docs).collect()}
    assert got == reference.exact_substrings([(r[0], r[1]) for r in rows])
    assert sum(v[1] for v in got.values()) > 5000
    assert substring_exact.remove_repeats(none).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_substrings_of_few_letters(spark, seed):
    r = random.Random(seed)
    block = ["".join(r.choice("ab") for _ in range(r.randint(60, 140))) for _ in range(6)]
    data = [(i, "".join(r.choice(block) for _ in range(r.randint(1, 5)))) for i in range(40)] + [(40, "a" * 700), (41, "a" * 99), (42, "ab" * 200), (42, "ab" * 200)]
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in substring_exact.remove_repeats(spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)).collect()}
    assert got == reference.exact_substrings(data)


def test_exact_substrings_hold_little_memory():
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np

    rng = np.random.default_rng(1)
    texts = [rng.integers(97, 123, 2000).astype(np.uint8).tobytes().decode() for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    shared, edges = SimpleNamespace(value=b"\xff" * (1 << 17)), SimpleNamespace(value=[])

    def peak(run, batches):
        next(run(iter(batches)))  # tables that stay
        tracemalloc.start()
        n = sum(b.num_rows for b in run(iter(batches)))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return n, most / (1 << 20)

    n, most = peak(substring_exact._contexts(100, 24, 20, shared, edges), [batch])
    assert n > 50_000 and most < 60
    n, most = peak(substring_exact._key_rows(100, 24), [batch.select(["text"])])
    assert n > 100_000 and most < 60
    found = pa.Table.from_batches(substring_exact._contexts(100, 24, 20, shared, edges)(iter([batch])))
    rows = found.to_pylist()
    found = found.append_column("lead", pa.array([r["context"][r["most"] : r["most"] + 24] for r in rows], pa.binary())).sort_by("lead")
    assert peak(substring_exact._later(100, 24), found.to_batches(max_chunksize=10_000))[1] < 60


def test_multikey_sort():
    import numpy as np

    x = np.random.default_rng(1).integers(0, 3, (500, 24)).astype(np.uint8)
    order, common = substring_exact.multikey_sort(x)
    want = sorted(x[i].tobytes() for i in range(len(x)))
    assert [x[i].tobytes() for i in order] == want
    for k in range(1, len(x)):
        a, b = want[k - 1], want[k]
        assert common[k] == next((i for i in range(24) if a[i] != b[i]), 24)


@pytest.mark.parametrize("blocks", [1_000_000, 40])
def test_contamination(spark, docs, rows, none, blocks):
    items = [(i, " ".join((r[1] or "").split()[3:30])) for i, r in enumerate(rows[:12])] + [(90, rows[20][1].upper()), (91, "two words"), (92, None), (93, ""), (94, rows[4][1]), (95, rows[4][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontamination.find_contamination(docs, bench, block_windows=blocks)
    names = F.array_sort(F.transform(F.col("contamination.items"), lambda i: i.cast("string")))
    got = found.select("doc_id", "contamination.n_words", decontamination.hit_words(F.col("contamination")), F.size(names), F.sha2(F.array_join(names, ","), 256), F.size("contamination.starts") > 0).collect()
    want = reference.contamination([(r[0], r[1]) for r in rows], items)
    assert sorted(map(tuple, got)) == sorted(want) and sum(w[5] for w in want) > 5
    assert sorted(decontamination.decontaminate(docs, bench, block_windows=blocks).columns) == sorted(docs.columns)
    assert decontamination.find_contamination(none, bench).count() == 0
    assert decontamination.decontaminate(docs, bench.where("false")).count() == len(rows)


@pytest.mark.parametrize("small", [line_dedup.SMALL, 0])
def test_line_dedup(docs, rows, none, small):
    got = {r["doc_id"]: r for r in line_dedup.remove_lines(docs, min_sites=5, found="gone", small=small).collect()}
    bad = reference.boilerplate([(r[0], r[1], r[3]) for r in rows], 5)
    assert bad
    for i, text, *_ in rows:
        if text is None:
            assert got[i]["text"] is None and got[i]["gone"] == 0
        else:
            kept = [x for x in text.split("\n") if x not in bad]
            assert got[i]["text"] == "\n".join(kept) and got[i]["gone"] == len(text.split("\n")) - len(kept)
    assert line_dedup.remove_lines(none, small=small).count() == 0


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(docs, rows, none, percent):
    want, sizes = reference.near_duplicates([(r[0], r[1]) for r in rows], percent)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs, percent).collect()}
    assert {i: g["component_id"] for i, g in got.items()} == want
    assert {i: g["n_shingles"] for i, g in got.items()} == sizes
    assert all(g["kept"] == (i == want[i]) for i, g in got.items())
    assert len(set(want.values())) < len(rows) - 8
    assert sorted(r["doc_id"] for r in near_dedup.keep_one(docs, percent=percent).collect()) == sorted(set(want.values()))
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_duplicates_in_small_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    want, _ = reference.near_duplicates([(r[0], r[1]) for r in rows])
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()} == want


def test_passages(docs, rows, none):
    got = {r["doc_id"]: r for r in passages.passage_report(docs).collect()}
    assert len(got) == len(rows)
    for i in range(0, 60, 6):
        assert got[i]["has_passage"] and got[i]["class_id"] == 0 and got[i]["n_shared_words"] >= 70
    for i, text, *_ in rows:
        assert got[i]["n_words"] == len(reference.words(text))
        if i < 60 and i % 6:
            assert not got[i]["has_passage"] and got[i]["class_id"] == i
    assert passages.passage_report(none).count() == 0


def test_added_tokens_are_ids():
    from tokenizers import Tokenizer

    coder, plain = packing.byte_bpe(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for text in ("a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>\n  y", "<|endoftext", "<|endoftext|"):
        want = plain.encode(text, add_special_tokens=False).ids
        assert coder.encode(text, allowed_special="all") == want
    got = next(iter(packing._cutter(tokenizer_path(), 64, 1)(iter([pa.record_batch({"doc_id": [7], "text": ["a <|endoftext|> b"]})]))))
    assert got.column("doc_tokens").to_pylist() == [5]


def test_passages_agree_with_every_pair(docs, rows):
    links = reference.passage_links([(r[0], r[1]) for r in rows])
    first = {}
    for i, t, *_ in rows:
        first.setdefault(t, i)
    want = reference.components([r[0] for r in rows], links)
    got = {r["doc_id"]: r for r in passages.passage_report(docs).collect()}
    assert len(links) > 100 and {i: got[i]["class_id"] for i in want} == want
    assert {i for i in got if got[i]["has_passage"]} == {i for p in links for i in p}


def test_passages_among_scattered_shingles_are_found(spark):
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    noise = lambda n: [word() for _ in range(n)]
    data, pairs = [], []
    for g in range(30):
        p = noise(60)
        scattered = lambda: " ".join(w for i in range(0, 56) for w in [*p[i : i + 5], *noise(5)])  # noqa: E731, B023
        at = 10 * g
        data += [(at, scattered()), (at + 9, scattered())] + [(at + 3 + k, " ".join([*noise(60), *p, *noise(60)])) for k in range(2)]
        pairs.append((at + 3, at + 4))
    r.shuffle(data)
    found = {(x["x"], x["y"]) for x in passages.near_passages(spark.createDataFrame(data, "doc_id bigint, text string")).collect()}
    assert found == set(pairs)


def test_passages_hold_small_batches(spark, docs, monkeypatch):
    """No Arrow batch of texts or tokens has more than ARROW_ROWS rows; the session's setting comes back, and hashes are told over batches."""
    name, sizes = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)
    monkeypatch.setattr(passages, "connected_components", lambda edges, f=passages.connected_components: sizes.append(spark.conf.get(name)) or f(edges))
    passages.passage_report(docs).collect()
    assert sizes and set(sizes) == {str(passages.ARROW_ROWS)} and spark.conf.get(name) == before
    text = " ".join(f"word{i}" for i in range(80))
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i], "text": [text]}) for i in range(2)]
    (told,) = passages._centres(5, 46, 4)(iter(batches))
    assert told.num_rows and all(told.column("many").to_pylist())


def test_repeated_bitmap(spark):
    r = random.Random(8)
    rows = [(r.getrandbits(64) - 2**63, r.random() < 0.1) for _ in range(300)]
    rows += r.sample(rows, 60)
    n = defaultdict(int)
    for h, many in rows:
        n[h] += 1 + many
    want = {(h % 2**64) >> 52 for h in n if n[h] > 1}
    bits = common.repeated_bitmap(spark.createDataFrame(rows, "h bigint, many boolean"), 12)
    assert {i for i in range(1 << 12) if bits[i >> 3] >> (i & 7) & 1} == want


def test_passages_in_a_large_open_group(spark):
    """A phrase of 24 words in many documents makes large groups of unlike cells; pairs among them share more, or a line of 48 words."""
    r = random.Random(4)
    noise = lambda n: ["".join(r.choice("klmnopqrst") for _ in range(7)) for _ in range(n)]
    phrase, line = noise(24), noise(48)
    data = [(i, " ".join([*noise(40), *phrase, *noise(40)])) for i in range(120)]
    twin = noise(40)
    data += [(200 + k, " ".join([*noise(30), *phrase, *twin, *noise(30)])) for k in (0, 50)]
    data += [(300 + k, " ".join([*noise(40), *line[:26], *noise(3), *line[26:], *noise(40)])) for k in range(40)]
    data += [(150 + 400 * k, " ".join([*noise(40), *line, "same", "end", *noise(40)])) for k in range(2)]
    want = reference.components([d[0] for d in data], reference.passage_links(data))
    got = {x["doc_id"]: x["class_id"] for x in passages.passage_report(spark.createDataFrame(data, "doc_id bigint, text string")).collect()}
    assert want[250] == 200 and want[550] == 150 and got == want


@pytest.mark.parametrize("block", [passages.BLOCK, 16])
def test_passages_in_a_large_open_group_make_no_row_a_token(spark, monkeypatch, block):
    """Cells of one group travel with their tokens; the groups are told from one exchange of the cells."""
    r = random.Random(5)
    noise = lambda n: ["".join(r.choice("klmnopqrst") for _ in range(7)) for _ in range(n)]
    line = noise(48)
    data = [(i, " ".join([*noise(40), *line[:26], *noise(3), *line[26:], *noise(40)])) for i in range(60)]
    data += [(150 + 400 * k, " ".join([*noise(40), *line, "same", "end", *noise(40)])) for k in range(2)]
    plans, tables = [], []

    def cut(df, name, f=passages.cut):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        tables.append(name)
        return f(df, name)

    monkeypatch.setattr(passages, "cut", cut)
    monkeypatch.setattr(passages, "BLOCK", block)
    got = {x["doc_id"]: x["class_id"] for x in passages.passage_report(spark.createDataFrame(data, "doc_id bigint, text string")).collect()}
    assert got == reference.components([d[0] for d in data], reference.passage_links(data))
    assert "open-ties" in tables and not any("inline(" in p for p in plans) and not {"cells", "ends", "tokens"} & set(tables)


def test_places_shared(monkeypatch):
    import numpy as np

    monkeypatch.setattr(passages, "COLUMNS", 3)
    rng = np.random.default_rng(3)
    lists = [np.unique(rng.integers(0, 25, rng.integers(0, 12))) for _ in range(30)]
    times = [rng.integers(1, 4, len(x)) for x in lists]
    got = passages._places_shared(np.repeat(np.arange(30), [len(x) for x in lists]), np.concatenate(lists) * 2**40, np.concatenate(times), 30)
    for i in range(30):
        for j in range(30):
            want = sum(n for t, n in zip(lists[i].tolist(), times[i].tolist(), strict=True) if t in lists[j].tolist())
            # tokens of one cell alone are shared with none, nor with itself
            assert i == j or got[i, j] == want
    assert not passages._places_shared(np.arange(3), np.arange(3), np.ones(3), 3).any()


def test_passages_with_null_keys_and_clashing_names(spark):
    r = random.Random(2)
    p = " ".join("".join(r.choice("abcdef") for _ in range(6)) for _ in range(80))
    data = [(1, p, "x", 1), (None, p, "y", 2), (2, "other " + p, "z", 3), (None, None, None, None), (3, None, None, 4)]
    got = passages.passage_report(spark.createDataFrame(data, "doc_id bigint, text string, class_id string, h bigint")).collect()
    assert sorted((x["doc_id"] or 0, x["class_id"] or 0, x["has_passage"]) for x in got) == [(0, 0, False), (0, 0, False), (1, 1, True), (2, 1, True), (3, 3, False)]


def test_edited_passage_is_found(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    p = [word() for _ in range(90)]
    q = list(p)
    q[45] = "edited"
    text = lambda m: " ".join([*(word() for _ in range(80)), *m, *(word() for _ in range(80))])
    data = [(1, text(p)), (2, text(q)), (3, text([])), (4, text([word() for _ in range(90)]))]
    got = {x["doc_id"]: x["has_passage"] for x in passages.passage_report(spark.createDataFrame(data, "doc_id bigint, text string")).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}


def test_passages_among_looser_variants_are_found(spark):
    r = random.Random(31)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    many = lambda n: [word() for _ in range(n)]

    def loose(p):
        at = r.sample(range(6, 55, 8), 5)
        return [word() if i in at else w for i, w in enumerate(p)]

    rows, middle = [], []
    for group in range(6):
        p = many(60)
        for j in range(22):
            rows.append((group * 100 + j, " ".join([*many(40), *(p if j in (10, 11) else loose(p)), *many(40)])))
        middle.append((group * 100 + 10, group * 100 + 11))
    found = {(x["x"], x["y"]) for x in passages.near_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert set(middle) <= found


def covered(found, side):
    return {i for x in found for i in range(*x[2 * side : 2 * side + 2])}


def test_runs_are_those_of_brute_force():
    import numpy as np

    r = np.random.default_rng(5)
    hits = 0
    for trial in range(60):
        base, extra = list(range(1, 71)), iter(range(1000, 9000))
        sides = []
        for _ in range(2):
            t, i = [], 0
            while i < len(base):
                how = r.random()
                cut, new = (r.integers(1, 6), r.integers(0, 6)) if how < (trial % 6) * 0.02 else (0, 0)
                t += [next(extra) for _ in range(new)]
                i += cut
                t += base[i : i + 1]
                i += 1
            sides.append(np.array([*(next(extra) for _ in range(r.integers(0, 5))), *t], np.uint32))
        u, v = sides
        want = []
        same = u[:, None] == v[None, :]
        for a in range(len(u)):
            for b in range(a + 20, len(u) + 1):
                cols = np.flatnonzero(same[a:b].any(axis=0))
                for k, c in enumerate(cols):
                    d = cols[k:] + 1
                    both = np.arange(1, len(d) + 1)
                    ok = (d - c >= 20) & (100 * both >= 80 * (b - a + d - c - both))
                    # both ends are shared tokens
                    want += [(a, b, c, int(e)) for e in d[ok] if same[a, c:e].any() and same[b - 1, c:e].any() and same[a:b, c].any()]
        got = passages.shared_runs(u, v, 20, 80)
        assert covered(got, 0) == covered(want, 0) and covered(got, 1) == covered(want, 1)
        hits += bool(want)
    assert 20 < hits


def test_runs_inside_and_across_edits():
    import numpy as np

    def tokens(words):
        return np.array([hash(tuple(words[i : i + 5])) & 0xFFFFFFFF for i in range(len(words) - 4)], np.uint32)

    p = list(range(140))
    q = [-w if i >= 64 and (i - 64) % 7 == 3 else w for i, w in enumerate(p)]
    found = passages.shared_runs(tokens(p), tokens(q), 46, 80)
    assert set(range(60)) <= covered(found, 0)
    q = [-w - 1 if 48 <= i < 53 else w for i, w in enumerate(p[:100])]
    assert passages.shared_runs(tokens(p[:100]), tokens(q), 46, 80) == [(0, 96, 0, 96)]
    assert reference.sure_run(46, 80, 5) == 21
    # two passages in another order, in whole documents
    x, y = [*p[:70], *range(500, 560), *p[70:]], [*p[70:], *range(800, 900), *p[:70]]
    assert reference.whole_runs(tokens(x), tokens(y), 46, 80, 21) == [(0, 66, 170, 236), (130, 196, 0, 66)]


def test_compact_windows_cover_every_run():
    import numpy as np

    h = np.random.default_rng(4).integers(0, 50, 120).astype(np.uint64)
    first = np.array([0, 40, 40, 120])
    for a, b in ((0, 40), (40, 120)):
        lo, c, hi = passages.compact_windows(h, first, 8)
        for i in range(a, b - 7):
            for j in range(i + 7, b):
                hit = [k for k in range(len(c)) if lo[k] <= i <= c[k] <= j <= hi[k]]
                assert len(hit) == 1 and h[c[hit[0]]] == h[i : j + 1].min()


def test_hll_band_is_settled_exactly(spark):
    rows = [(i, "spread line", f"s{i}") for i in range(10)] + [(100 + i, "near line", f"s{i}") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert {r["doc_id"] for r in line_dedup.remove_lines(df, 10, found="n").where("n > 0").collect()} == set(range(10))


def test_fingerprint_is_of_the_set(spark):
    text = "a b c d e f g"
    got = near_dedup.near_duplicates(spark.createDataFrame([(7, text), (3, text.upper()), (5, " " + text)], "doc_id bigint, text string")).collect()
    assert {r["component_id"] for r in got} == {3}


def test_long_runs_of_white_space_are_packed(spark):
    from tokenizers import Tokenizer

    texts = ["a" + " " * 1_000_000 + "b", "\n" * 200_000 + "<|endoftext|> x", "plain"]
    coder = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), tokenizer_path())
    want = {i: len(coder.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["doc_tokens"] for r in got.select("doc_id", "doc_tokens").distinct().collect()} == want


def test_disjoint_large_sets_share_nothing():
    import numpy as np

    left, right = (pa.array([" ".join(f"{side}{i}" for i in range(120_000))]) for side in "ab")
    (_, u), (_, v) = (next(near_dedup.shingle_sets(x, 5)) for x in (left, right))
    assert len(u) == len(v) == 119_996 and not len(np.intersect1d(u, v, assume_unique=True))


def test_null_keys_are_compared_with_nothing(spark):
    text = " ".join(f"word{i}" for i in range(90))
    df = spark.createDataFrame([(None, text), (2, text), (3, text), (None, None)], "doc_id bigint, text string")
    near = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect())
    assert near == [(0, None, True), (0, None, True), (2, 2, True), (3, 2, False)]
    cut = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring_exact.remove_repeats(df).collect())
    assert cut == [(0, 0), (0, 0), (2, 0), (3, len(text))]


@pytest.mark.parametrize("small", [200_000, 0])
def test_lines_with_clashing_names(spark, small):
    rows = [(i, f"same line here\nown {i}", f"s{i}", [f"mine{i}"], i, "x") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _kept array<string>, _k bigint, _slots string")
    got = line_dedup.remove_lines(df, small=small)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [(i, f"own {i}", *r) for i, _, *r in rows]


def test_sharding_repeated_rows_and_the_next_version(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    same = spark.createDataFrame([(1, "the same text")] * 2000 + [(None, "null")] * 100, "doc_id bigint, text string")
    first = sharding.shard_by_bytes(same, 8, map_path=path).collect()
    size = [sum(r["size"] for r in first if r["shard"] == s) for s in range(8)]
    assert max(size) - min(size) <= 40 and {r["map_version"] for r in first} == {1}
    assert all(sorted(r["slot"] for r in first if r["shard"] == s) == list(range(sum(r["shard"] == s for r in first))) for s in range(8))
    again = sharding.shard_by_bytes(same.unionByName(spark.createDataFrame([(9, "y" * 900)], same.schema)), 8, map_path=path).collect()
    assert {r["map_version"] for r in again} == {2} and len(again) == 2101
    assert sharding.latest_version(spark, path) == 2


def test_one_long_item_is_dealt_over_blocks(spark):
    words = [f"w{i}" for i in range(300)]
    items = [(1, " ".join(words)), (2, "just four words here")]
    rows = [(1, " ".join(["x"] * 5 + words[40:80])), (2, " ".join(words[:9])), (3, "no just four words here !")]
    found = decontamination.find_contamination(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), block_windows=50)
    span = lambda c: sum(e - s for s, e in zip(c["starts"], c["ends"], strict=True))
    got = {r["doc_id"]: (r["contamination"]["items"], span(r["contamination"])) for r in found.collect()}
    assert got == {1: ([1], 40), 2: ([], 0), 3: ([2], 4)}
