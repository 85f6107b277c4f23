import duckdb
import pytest

import corpus_pipeline
from scribemend.llm import queries

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources", "byte-level BPE"]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_like_its_sql(llm, name):
    engine = duckdb.connect()
    for table in ("documents", "pages", "labels", "conversations"):
        engine.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    want = engine.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](llm, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


def test_pipeline_stages(llm):
    """Each stage keeps the columns of documents, and does to its input what its operator says."""
    from test_exact import norm
    from test_jaccard import classes
    from fractions import Fraction

    docs = llm.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, [docs.collect()]
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.stored(stage(llm, docs, SF), "step")
        assert docs.columns == columns
        steps.append(docs.collect())
    given, clean, single, apart, mixed = ([(r["doc_id"], r["text"]) for r in rows] for rows in steps)
    assert set(clean) <= set(given) and len(clean) >= 0.8 * len(given)
    assert sorted(norm(t) for _, t in single) == sorted({norm(t) for _, t in clean}) and set(single) <= set(clean)
    heads = {name for name, _, head in classes(single, 5, Fraction(4, 5)) if name == head}
    assert {name for name, _ in apart} == heads
    assert set(mixed) <= set(apart) and max(mixed.count(row) for row in set(mixed)) <= 2
    last = corpus_pipeline.STAGES[4][1](llm, docs, SF)
    assert last.count() == len(mixed)


def test_finished_stages_leave_no_folder(llm):
    """What a stage stored is gone when the next one has begun, and its documents can still be read."""
    from pathlib import Path

    from scribemend.session import made_paths, shared_dir

    folder = Path(shared_dir(llm).removeprefix("file://"))
    before = {p.name for p in folder.iterdir()}
    docs, seen = llm.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        start = set(made_paths(llm))
        docs = stage(llm, docs, SF)
        seen.append({p for p in made_paths(llm) if p not in start})
        if name != corpus_pipeline.STAGES[-1][0]:
            docs = corpus_pipeline.stored(docs, "result")
    assert docs.count() > 0 and sum(map(len, seen)) > 20
    left = {p.name for p in folder.iterdir()} - before
    for own in seen[:-1]:
        assert not {p.rsplit("/", 1)[1] for p in own} & left
    assert corpus_pipeline.run(llm, SF).count() == docs.count()
    assert len([p for p in folder.iterdir() if p.name not in before and p.name not in left and p.name.split("-")[0] in ("toxicity", "exact", "n")]) == 0


@pytest.mark.parametrize("rows", [[], [(None, None), (None, "a b"), (1, ""), (1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f g"), (2, None)]])
def test_pipeline_of_odd_rows(llm, documents, tmp_path, rows):
    """Nulls, repeated rows, an empty table and columns of clashing names go through all stages."""
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    llm.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = llm.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns, docs = docs.columns, corpus_pipeline.stored(stage(llm, docs, str(tmp_path)), "step")
        assert docs.columns == columns
    out = corpus_pipeline.run(llm, str(tmp_path))
    assert out.count() == docs.count()
    if rows:
        assert {r["doc_id"] for r in docs.collect()} <= {None, 1} and docs.filter("text = 'a b c d e f g'").count() >= 1
