import json
import os
import shutil
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + ":" + os.environ.get("PYTHONPATH", "")

import pytest  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def document(i, text):
    chunk = lambda k: {"chunk_id": f"d{i}_chunk_{k}_v1", "section_title": f"Section {k}", "section_path": f"A / {k}", "content": f"{text} part {k}", "chunk_index": k, "prev_chunk_id": f"d{i}_chunk_{k - 1}_v1" if k else None, "next_chunk_id": f"d{i}_chunk_{k + 1}_v1" if k < 2 else None, "entities": [{"name": f"Firm {i}", "desc": None}], "relations": [{"subject": "", "predicate": "covers", "object": text}], "doc_tree": {"title": "t", "children": []} if not k else None}
    return {"doc_id": f"d{i}", "doc_type": "REG", "version_ts": 1, "structured_data": {"insurer": "Acme", "contract_name": text}, "chunks": [chunk(k) for k in range(3)]}


def write_documents(at):
    for i, text in enumerate(["flood damage", "fire damage", "theft"]):
        d = at / f"d{i}"
        d.mkdir(parents=True)
        for name in (f"d{i}_v1.json", "latest.json"):
            (d / name).write_text(json.dumps(document(i, text)))
    (at / "bad.json").write_text("{")
    (at / "empty.json").write_text(json.dumps({"doc_id": "e", "chunks": []}))


@pytest.fixture(scope="session")
def built(spark, tmp_path_factory):
    """An index of write_documents with metadata, built once; an index may be copied."""
    from strataseek.plans.engine import Retriever

    at = tmp_path_factory.mktemp("built")
    write_documents(at / "docs")
    Retriever(spark, str(at / "docs"), str(at / "index"), "insurance")
    return at / "index"


@pytest.fixture
def folder(tmp_path, built):
    write_documents(tmp_path / "docs")
    shutil.copytree(built, tmp_path / "index")
    return tmp_path
