"""Every query with SQL against DuckDB on the smallest tables; the rest must run with a stable schema."""

import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import millrace.queries as archive

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    own = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}") if isinstance(v, float) else v
    return sorted(columns), sorted((tuple(own(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(archive.SQL))
def test_against_sql(spark, duck, name):
    got = archive.QUERIES[name](spark, FOLDER)
    want = duck.sql(archive.SQL[name])
    assert plain(got.columns, map(tuple, got.collect())) == plain(want.columns, want.fetchall())


def read(name):
    return duckdb.sql(f"SELECT * FROM '{FOLDER}/{name}.parquet'").df()


def test_fuzzy_title_match(spark):
    """Against every pair whose bounds of the ratio allow a match."""
    import difflib

    def ratio(a, b):
        matcher = difflib.SequenceMatcher(None, b, a)
        return matcher.ratio() if matcher.real_quick_ratio() >= 0.86 and matcher.quick_ratio() >= 0.86 else 0.0

    folder = "/root/testdata/sf0.01"
    first = lambda t: " ".join(t.split(".")[0].lower().split())
    left, right = (duckdb.sql(f"SELECT {c}, text FROM '{folder}/{n}.parquet'").fetchall() for c, n in (("item_id", "benchmark"), ("doc_id", "documents")))
    keys = {first(t) for _, t in right} - {""}
    best = {i: max((1.0 if first(t) == b else ratio(first(t), b), b) for b in keys) for i, t in left}
    got = {r.left_id: (r.ratio, r.right_key) for r in archive.QUERIES["fuzzy_title_match"](spark, folder).collect()}
    assert set(got) == {i for i, b in best.items() if b[0] >= 0.86}
    assert all(got[i][0] == pytest.approx(best[i][0]) and got[i][1] == best[i][1] for i in got)


def test_page_main_text(spark):
    """Against the pages cut at their tags."""
    import html
    import re

    want = {}
    for page_id, page in zip(read("pages").page_id, read("pages").html, strict=True):
        page = re.sub(r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->", "", page)
        blocks, open_ = [], []
        for tag, text in re.findall(r"<(/?[a-z0-9]+)[^>]*>([^<]*)", page):
            name = tag.strip("/")
            if tag[0] == "/":
                if name in open_:
                    del open_[len(open_) - 1 - open_[::-1].index(name) :]
            else:
                if name in ("p", "h1", "h2", "h3", "title"):
                    blocks.append([name, ""])
                if name not in ("br", "img", "meta", "link", "input", "hr"):
                    open_.append(name)
            if blocks and blocks[-1][0] in open_:
                blocks[-1][1] += html.unescape(text)
        plain = [(n, " ".join(t.split())) for n, t in blocks]
        longest = max((t for n, t in plain if n == "p" and len(t) > 120), key=len, default="")
        want[int(page_id)] = (next((t for n, t in plain if n[0] == "h" and t), ""), longest)
    got = {r.page_id: (r.title, r.abstract) for r in archive.QUERIES["page_main_text"](spark, FOLDER).collect()}
    assert got == want


def test_embedding_layout(spark):
    """A point for each document with terms; equal texts meet; the spread is the asked one."""
    docs = read("documents")
    got = {r.doc_id: (r.x, r.y) for r in archive.QUERIES["embedding_layout"](spark, FOLDER).collect()}
    assert set(got) <= set(docs.doc_id) and len(got) > 0.9 * len(docs)
    for _, same in docs.groupby("text").doc_id:
        placed = [got[i] for i in same if i in got]
        assert all(p == pytest.approx(placed[0], abs=1e-6) for p in placed)
    for axis in (0, 1):
        values = [p[axis] for p in got.values()]
        mean = sum(values) / len(values)
        assert abs(mean) < 1e-6 and (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5 == pytest.approx(10)


def test_every_query_is_held_against_something():
    assert set(archive.QUERIES) - set(archive.SQL) == {"fuzzy_title_match", "page_main_text", "embedding_layout"}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_subpackage(tmp_path):
    root = Path(__file__).resolve().parent.parent
    for path in [root / "__spark_entry__.py", *(root / "millrace").rglob("*.py")]:
        at = tmp_path / path.relative_to(root)
        if "llm" not in at.relative_to(tmp_path).parts:
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_bytes(path.read_bytes())
    code = "import __spark_entry__ as e; print(len(e.queries()), [q for q in e.queries() if q.startswith('op') or q == 'pipeline'])"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.stdout.split(maxsplit=1) == [str(len(archive.QUERIES)), "[]\n"], done.stderr
