import duckdb


def test_duplicates_link_across_heads(spark, tmp_path):
    """Hashes of documents 74220 to 74222 and 122706 to 122708 differ in six bits, some in their first 14 digits."""
    from boxwright.plans import datasets, registry  # noqa: F401

    ids = [*range(74220, 74223), *range(122706, 122709), *range(9)]
    spark.createDataFrame([(i,) for i in ids], "doc_id bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, registry.QUERIES["O12"](spark, str(tmp_path)).collect()))
    assert {k: c for k, c in got if k >= 74220} == dict.fromkeys(ids[:6], 74220)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(registry.SQL["O12"]).fetchall())


def test_pairs_of_hashes_are_whole(spark):
    """As all pairs, with up to seven bits flipped anywhere."""
    import random

    from boxwright.operators import matching

    r, hashes = random.Random(5), []
    for _ in range(40):
        base = r.getrandbits(64)
        hashes += [base, *[base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 8))) for _ in range(4)]]
    rows = [(i, f"g{i % 3}", f"{h:016x}") for i, h in enumerate(hashes)]
    h = spark.createDataFrame(rows, "stem bigint, group_id string, phash string")
    for most in (3, 6, 7):
        want = {(i, j, d) for i in range(len(rows)) for j in range(i + 1, len(rows)) if rows[i][1] != rows[j][1] and (d := (hashes[i] ^ hashes[j]).bit_count()) <= most}
        assert sorted(map(tuple, matching.hamming_pairs(h, most).collect())) == sorted(want)
