"""Rules that hold for the whole library."""

import ast
from pathlib import Path

ROOT = Path(__file__).parent.parent / "quadrille"


def modules():
    return [(p, ast.parse(p.read_text())) for p in ROOT.rglob("*.py")]


def test_corpus_operators_are_imported_by_nothing_else():
    for path, tree in modules():
        if "llm" in path.parts:
            continue
        for node in ast.walk(tree):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_no_local_checkpoint_and_no_rdd():
    for path, tree in modules():
        used = {n.attr for n in ast.walk(tree) if isinstance(n, ast.Attribute)}
        assert not used & {"localCheckpoint", "rdd", "toPandas", "parallelize"}, path


def test_products_only_where_the_language_means_them():
    assert [p.name for p, t in modules() if any(isinstance(n, ast.Attribute) and n.attr == "crossJoin" for n in ast.walk(t))] == ["execute.py"]


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    import pytest

    from quadrille.functions.shared import NoSharedFolder, shared_dir

    unset = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: unset, getCheckpointDir=lambda: None)
    with pytest.raises(NoSharedFolder):
        shared_dir(SimpleNamespace(conf=unset, sparkContext=context), "x")
    there = SimpleNamespace(get=lambda *a: "hdfs://shared/")
    assert shared_dir(SimpleNamespace(conf=there, sparkContext=context), "x", keep=True).startswith("hdfs://shared/x-")
