"""Python workers need not have the library on their path."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
RUN = """
import sys
sys.path.insert(0, {root!r})  # as the entry module does: the driver's path alone
from crashlens.session import build_session
spark = build_session("local[2]", shuffle_partitions=2)
docs = spark.createDataFrame([(1, "one two three four five six", "en"), (2, None, None)], "doc_id long, text string, lang string")
labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
from crashlens.llm.align import align
from crashlens.llm.classifier import classify
from crashlens.llm.quality import judge
from crashlens.llm.substrings import remove_repeats
from crashlens.llm.tokens import token_counts
print("rows", *[df.count() for df in (align(docs), classify(docs, labels), judge(docs), remove_repeats(docs))])
print("tokens", sorted(r.k.n_words for r in token_counts(docs).collect()))
"""


def test_operators_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", RUN.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "rows 2 2 2 2" in done.stdout and "tokens [0, 6]" in done.stdout, done.stderr[-3000:]
