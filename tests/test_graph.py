"""Components against a plain union of sets; the number of rounds on paths."""

import math
import random

import pytest
from meridian.operators import frames, graph


def plain(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_plain_python(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(7, 7), (400, 401), (401, 400)]
    got = {x["node"]: x["root"] for x in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == plain([x for x in links if x[0] != x[1]])
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("order", ["ascending", "descending", "shuffled"])
def test_rounds_are_logarithmic(spark, monkeypatch, order):
    n, names = 1000, list(range(1000))
    if order == "shuffled":
        random.Random(4).shuffle(names)
    names = names[::-1] if order == "descending" else names
    written = []
    monkeypatch.setattr(graph, "cut", lambda df: (written.append(1), frames.cut(df))[1])
    got = graph.components(spark.createDataFrame(list(zip(names, names[1:])), "a long, b long"))
    assert {(x["root"]) for x in got.collect()} == {0} and got.count() == n
    assert len(written) <= 6 * math.log2(n)


def test_tables_are_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(frames, "shared_dir", lambda _: str(tmp_path))
    got = graph.components(spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long"))
    (folder,) = tmp_path.iterdir()
    assert len([x for x in folder.iterdir() if x.is_dir()]) == 1 and got.count() == 21
    frames.clear(spark)
    assert not folder.exists()


@pytest.mark.parametrize(("master", "raises"), [("local", False), ("local[8]", False), ("local-cluster[3,2,1024]", True), ("spark://host:7077", True), ("yarn", True)])
def test_no_folder_of_this_machine_on_a_cluster(master, raises):
    class Unset:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)
            setCheckpointDir = staticmethod(lambda path: None)

    Unset.sparkContext.master = master
    if raises:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            frames.shared_dir(Unset())
    else:
        assert frames.shared_dir(Unset())
