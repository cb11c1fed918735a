"""All pages from shared cubes: how often the sessions are read, and odd slices."""

import json
import os
import subprocess
import sys

from pyspark.sql import functions as F

from basketlens.operators.quality import split_products
from basketlens.plans import pages
from basketlens.sources.store import write_sessions
from basketlens.sources.tables import adapt_orders

HERE = os.path.dirname(os.path.abspath(__file__))


def test_all_pages_read_the_sessions_twice(spark, folder, tmp_path):
    """Counted over every job, those behind checkpoints included."""
    store = str(tmp_path / "store")
    write_sessions(adapt_orders(spark, folder), store)
    out = subprocess.run([sys.executable, f"{HERE}/count_reads.py", store, str(tmp_path)],
                         capture_output=True, text=True, check=True, timeout=600)
    got = json.loads(out.stdout.strip().splitlines()[-1])
    total = adapt_orders(spark, folder).count()
    assert got["rows"] > 100
    assert sum(got["read"]) <= 2 * total, got


def _same(a, b):
    show = lambda df: sorted(map(tuple, df.collect()), key=str)
    return show(a) == show(b)


def test_shared_pages_equal_single_pages(spark, sessions):
    """A slice whose dates, products, codes and customers have nulls."""
    odd = F.col("session_id") % 7
    df = sessions.filter("product_category = 2").withColumns({
        c: F.when(odd != i, F.col(c)) for i, c in enumerate(
            ["visit_date", "product_id", "user_type", "customer_id", "payment_method"])}).checkpoint()
    every = pages.every_page(df).checkpoint()
    for name, page in pages.PAGES.items():
        assert _same(every.filter(F.col("page") == name), page(df)), name


def test_no_rows_leave_a_note_a_page(spark, sessions):
    got = pages.every_page(sessions.filter("false")).collect()
    assert sorted(r.page for r in got) == sorted(pages.PAGES) and {r.kind for r in got} == {"note"}


def test_products_in_several_categories(spark):
    rows = [(1, 1), (1, 1), (2, 1), (2, 3), (3, None), (3, 2), (None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "product_id int, product_category int")
    assert tuple(split_products(df).first()) == (3, 1)
    assert tuple(split_products(df.filter("false")).first()) == (0, 0)
