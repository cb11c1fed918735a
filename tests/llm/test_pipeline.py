"""The pipeline, its registration, and that the rest does without it."""

import subprocess
import sys

import __spark_entry__ as entry
import corpus_pipeline

from basketlens.llm.common import table


def test_registered():
    names = {n.split("_")[0] for n in entry.queries() if n.startswith("op") and n[2].isdigit()}
    assert names == {f"op{i}" for i in range(1, 14)} and "pipeline" in entry.queries()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "n-gram Jaccard join", "mixing", "BPE"]


def test_stages(spark, folder, tmp_path):
    docs = table(spark, folder, "documents")
    labels = {r.doc_id: r.quality for r in table(spark, folder, "labels").collect()}
    before = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, folder).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert after.columns == docs.columns
            had, has = {r.doc_id for r in before.select("doc_id").collect()}, {r.doc_id for r in after.select("doc_id").collect()}
            assert has <= had
            if i == 0:
                clean = [k for k in had if labels.get(k) == 1]
                assert sum(k in has for k in clean) >= 0.97 * len(clean)
        else:
            assert after.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256"] and after.count() == before.count()
        before = after


def test_stages_bear_everything(spark, docs, nothing, folder):
    for frame in (docs, nothing):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, frame, folder).collect()


def test_deduplicate_keeps_one_row_of_each_group(spark, docs, folder):
    words = [f"v{i}" for i in range(300)]
    one, other, third = (" ".join(words[i:i + 80]) for i in (0, 100, 200))
    rows = [(5, one, "a")] * 500 + [(5, one, "b"), (7, one, "a"), (5, other, "a"), (3, other, "a"), (5, third, "a"), (5, third + " tail", "a"),
                                    (6, None, "a"), (6, None, "a"), (6, "", "a"), (None, one, "a"), (None, one, "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    kept = corpus_pipeline.deduplicate(spark, frame, folder)
    got = sorted((r.doc_id or 0, (r.text or "").removesuffix(" tail")) for r in kept.collect())
    assert kept.columns == frame.columns
    assert got == sorted([(5, one), (3, other), (5, third), (6, ""), (6, ""), (0, one), (0, one)])
    ids = [r.doc_id for r in corpus_pipeline.deduplicate(spark, docs, folder).select("doc_id").collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids))


def test_the_rest_imports_without_the_package(tmp_path):
    code = ("import sys; sys.modules['basketlens.llm'] = None; sys.path.insert(0, '.')\n"
            "class Gone:\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name in ('corpus_pipeline', 'basketlens.llm'):\n"
            "            raise ModuleNotFoundError('gone', name=name)\n"
            "sys.modules.pop('basketlens.llm'); sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e; assert len(e.queries()) > 100 and not [n for n in e.queries() if n.startswith(('op1_', 'pipeline'))]")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rpartition("/")[0], timeout=120)
