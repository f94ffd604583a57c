"""Quality rules: the oracle over odd rows, and removal of shared lines."""

import duckdb
import pandas as pd

from plumbline.llm import quality


def rows():
    words = [" ".join(f"w{k}x{j}" for j in range(70)) for k in range(40)]
    out = [(k, f"Shared  LINE of the host\n{words[k]}\nshared line of the HOST", "a") for k in range(30)]
    out += [(100 + k, f"Shared line of the host\n{words[k]}", "b") for k in range(15)]
    boiler = "\n".join([" ".join(f"b{j}" for j in range(60))])
    out += [(200 + k, f"{boiler}\n{' '.join(f'v{k}z{j}' for j in range(50))}", "c") for k in range(25)]
    out += [(300, None, "a"), (301, "", None), (302, " \n\t\n ", None), (303, "a b c a b c a b c " * 20, "a")]
    out += [(304, "# $ % & | < > *é日", "d"), (305, "x\nx\nx \n x\ny", "d"), (None, words[35], None)]
    out += [(306, words[36], "a")] * 3 + [(307, "word " * 20_000, "a"), (308, "A b\x0b\x0cc", "a")]
    return out


def test_odd_rows_match_the_oracle(spark):
    data = rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in data], "doc_id bigint, text string, source string, lines int, host string")
    got = quality.quality_rules(docs).toPandas()
    frame = pd.DataFrame(data, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", frame)
    want = con.execute(quality.ORACLE).df()
    def key(f):
        return sorted(tuple(None if pd.isna(v) else v for v in r) for r in f[list(got.columns)].astype(object).fillna(-1).values.tolist())
    assert key(got) == key(want)
    by = got.set_index("doc_id")
    assert by.loc[200, "removed_words"] == 60 and not by.loc[200, "kept"]  # depleted
    assert by.loc[5, "removed_words"] == 10 and by.loc[5, "kept"]
    assert by.loc[100, "removed_words"] == 0  # too few documents on that host


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert quality.quality_rules(docs).count() == 0


def test_texts_without_shared_lines(spark):
    data = rows() + [(400, "\n\n shared line OF the host \n\n  keep  me\n\nShared line of the host", "a")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    got = quality.without_limited_lines(docs)
    assert got.columns == ["doc_id", "text", "removed_words"]
    boiler = " ".join(f"b{j}" for j in range(60))
    gone = {("a", "shared line of the host"), ("c", boiler)}

    def plain(text, host):
        lines = [] if text is None else text.split("\n")
        keep = [x for x in lines if (host, " ".join(x.lower().split(" ")).strip().replace("  ", " ")) not in gone]
        return None if text is None else "\n".join(keep)

    want = [(k, plain(t, h), len((t or "").split()) - len((plain(t, h) or "").split())) for k, t, h in data]
    order = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted(want, key=order)
    by = {r.doc_id: r.text for r in got.collect()}
    assert by[400] == "\n\n\n  keep  me\n" and by[300] is None and by[5].startswith("w5x0")
    removed = {(r.doc_id, r.removed_words) for r in quality.quality_rules(docs).collect()}
    assert removed == {(r[0], r[2]) for r in want}
    empty = spark.createDataFrame([], docs.schema)
    assert quality.without_limited_lines(empty).count() == 0
