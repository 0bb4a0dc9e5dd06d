import duckdb

from tickloom.llm import license_scan as ls
from tickloom.llm.common import table


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


def test_against_sql(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    c = con.execute(ls.sql())
    names = [d[0] for d in c.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert rows(ls.scan(docs)) == sorted(repr(tuple(r[i] for i in order)) for r in c.fetchall())


def test_edges(spark):
    long = "lorem " * 50_000 + "MIT-License mit license. This work is licensed under the GNU General Public License, version 3"
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, long, 3), (3, long, 3), (4, "All rights reserved é", 4)], "doc_id long, text string, n_words int")
    got = ls.scan(docs).orderBy("doc_id").collect()
    assert len(got) == 5 and got[0].n_words == 0 and got[0].first_word is None and got[1].labels == ""
    assert got[2] == got[3] and got[2].n_base == 3 and got[2].base_labels == "gpl,mit" and "gpl-3.0" in got[2].labels
    assert (got[2].first_word, got[2].last_word) == (50_000, 50_011)
    assert got[4].labels == "proprietary" and got[4].score == 1.0 and got[4].n_base == 0 and got[4].n_words == 4
    assert ls.scan(docs.limit(0)).count() == 0
