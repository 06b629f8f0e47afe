"""Letter features are counted once, however often they are read."""

from sparktab.catalog import learning


def test_counts_once_and_like_plain_python(spark, tmp_path):
    texts = ["banana é", "", None, "ñandú über ÉA", "aaa\n😀eins"]
    rows = [(i, t, ["de", "es"][i % 2], 0 if t is None else len(t)) for i, t in enumerate(texts)]
    path = f"{tmp_path}/documents.parquet"
    schema = "doc_id bigint, text string, lang string, n_chars bigint"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
    found = learning.letter_rows(spark, str(tmp_path))
    # Other texts in their place: rows that were counted again would show them.
    spark.createDataFrame([(9, "zzz", "de", 3)], schema).write.mode("overwrite").parquet(path)
    got = {r.doc_id: r for r in found.collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, text in enumerate(texts):
        for count, share, letter in zip(learning.COUNTS, learning.SHARES, learning.LETTERS):
            if text is None:
                assert got[i][count] is None and got[i][share] == 0.0
            else:
                assert got[i][count] == text.count(letter)
                assert abs(got[i][share] - (100 * text.count(letter) / len(text) if text else 0.0)) < 1e-12
    kinds = dict(found.dtypes)
    assert all(kinds[c] == "double" for c in (*learning.COUNTS, *learning.SHARES))
