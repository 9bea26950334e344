from drowse.llm import alignment


def test_runs_and_row_groups_stay_small():
    """What a task holds beside its batch: a run's arrays, and a row group of links in the writer."""
    texts = ["word " * 6000] * 60 + [None, ""]
    runs = list(alignment._runs(texts))
    assert [i for a, z in runs for i in range(a, z)] == list(range(len(texts)))
    assert max(sum(len(t or "") for t in texts[a:z]) for a, z in runs) <= (1 << 18) + len(texts[0])
    assert int(alignment.STORED["parquet.block.size"]) <= 16 << 20
