import os
import subprocess
import sys
import textwrap
from pathlib import Path

from scribemend import session

ROOT = str(Path(__file__).resolve().parent.parent)


def run_alone(folder, code):
    """A session of its own process, with an empty Spark configuration and without this repository on the workers' path."""
    (folder / "conf").mkdir()
    (folder / "work").mkdir()
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYTHONPATH")} | {"SPARK_CONF_DIR": str(folder / "conf")}
    head = f"import sys; sys.path.insert(0, {ROOT!r})\n"
    done = subprocess.run([sys.executable, "-c", head + textwrap.dedent(code)], cwd=folder / "work", env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-3000:]
    return done.stdout


def test_local_session_without_any_setting(tmp_path):
    said = run_alone(tmp_path, """
        from scribemend import session
        spark = session.local_session("2", 2, "1g")
        table = session.stored(spark.range(3).toDF("id"), "three")
        print(table.count(), session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir"))
        """)
    assert said.split() == ["3", "True"]


def test_operators_on_a_plain_session(tmp_path):
    """The user's own session has no folder set and its workers do not know this package."""
    said = run_alone(tmp_path, """
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", 2).getOrCreate()
        from scribemend import session
        from scribemend.operators.aliases import resolve_aliases
        lexicon = spark.createDataFrame([("teh", "the", 1)], "alias string, canonical string, lex_order long")
        texts = spark.createDataFrame([(1, "teh end")], "id int, text string")
        for limit in (0, 10**6):
            print(resolve_aliases(texts, lexicon, limit=limit).first().resolved.text)
        session.cut_lineage(texts).count()
        """)
    assert said.split("\n")[:2] == ["the end"] * 2


def test_dropped_tables_are_gone_unless_they_are_read(spark):
    before = list(session.made_paths(spark))
    one, two = (session.stored(spark.range(k), "dropped") for k in (2, 3))
    mine = [p for p in session.made_paths(spark) if p not in before]
    assert len(mine) == 2
    gone = session.drop_paths(spark, mine, keep=one.filter("id > 0"))
    assert gone == mine[1:] and one.count() == 2
    assert not Path(mine[1].removeprefix("file://")).exists()
    assert session.drop_paths(spark, mine[:1]) == mine[:1] and session.made_paths(spark) == before
