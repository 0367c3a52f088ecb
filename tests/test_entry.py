import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert set(df.columns) == {"dataset", "event_id", "template", "occurrences"}


def test_oracle_keys_are_registered():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_checkpoint_dir_comes_from_the_session(spark, tmp_path):
    from logweave.session import checkpoint_dir, cut_lineage
    first = checkpoint_dir(spark)
    assert checkpoint_dir(spark) == first
    assert spark.conf.get("spark.checkpoint.dir") == first
    df = cut_lineage(spark.range(10))
    assert df.count() == 10


def test_core_queries_stand_without_the_libraries_of_the_optional_part():
    """With a library hidden that only the corpus operators use, the core queries still register."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import sys; sys.modules['ahocorasick'] = None; sys.modules['regex'] = None; sys.path.insert(0, sys.argv[1]); "
            "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') and '_' in k and k[2].isdigit() for k in q))")
    out = subprocess.run([sys.executable, "-c", code, root], capture_output=True, text=True, cwd="/", timeout=120)
    n, corpus = out.stdout.split()
    assert int(n) > 80 and corpus == "False", out.stderr


def test_programs_run_from_another_folder(tmp_path):
    """Workers find the package although the program starts elsewhere and no path is set."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import sys; sys.path.insert(0, sys.argv[1]); from logweave import get_session; from logweave.operators import mining\n"
            "spark = get_session('local[2]', shuffle_partitions=2)\n"
            "lines = spark.createDataFrame([('d', i, f'open file {i} now') for i in range(9)], 'dataset string, line_id long, content string')\n"
            "print(mining.mine_templates(lines, ['[0-9]+'], depth=2).select('template').distinct().collect()[0][0])")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code, root], capture_output=True, text=True, cwd=tmp_path, timeout=240, env=env)
    assert out.stdout.strip() == "open file <*> now", out.stderr[-2000:]
