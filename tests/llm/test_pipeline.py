"""The pipeline against a plain version of each stage."""

import re

from test_operators import check_packing, components_of, made, table


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from millrace.llm.quality_rules import repetition
    from millrace.llm.secret_scan import redacted
    from millrace.llm.vocabulary import tokenizer

    rows = made()
    rows += [(7000 + k, f"{' '.join(f'v{k}x{j}' for j in range(40))} token = \"{'0a1b2c3d' * 5}\"") for k in range(3)]
    rows += [(7100, rows[-1][1].replace(" ", "\n")), (7101, rows[-1][1].replace("v2x0 v2x1 ", "other ")), (7102, rows[-2][1])]
    # one id on rows of several texts: 7203 A, 7205 A' and 7205 B, 7207 B'
    one, two = (" ".join(f"{c}{j}" for j in range(60)) for c in "pq")
    rows += [(7203, one), (7205, one + " more"), (7205, two), (7207, two + " more"), (None, one + " without id"), (7208, "long " + " ".join(f"l{j}" for j in range(200_000)))]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")

    measured = [(r.doc_id, r.kept, r.n_words, r.word_chars) for r in repetition(table(spark, rows).coalesce(1)).collect()]
    assert [m[0] for m in measured] == [i for i, _ in rows]
    left = [r for r, m in zip(rows, measured, strict=True) if m[1]]
    seen, once = set(), []
    for i, t in left:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        if norm not in seen:
            seen.add(norm)
            once.append((i, t))
    _, lowest, _ = components_of(once)
    kept = [(i, redacted(t)) for (i, t), c in zip(once, lowest, strict=True) if i is None or i == c]
    assert len(rows) > len(left) > len(once) > len(kept) > 5 and sum("[secret]" in t for _, t in kept) == 3
    assert {(7203, one), (7205, two), (None, one + " without id")} <= set(kept)
    check_packing(corpus_pipeline.run(spark, str(tmp_path)).collect(), kept, tokenizer())

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == table(spark, rows).columns


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    table(spark, [(1, "x")]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_leave_no_tables_behind(spark, tmp_path):
    from pathlib import Path

    import corpus_pipeline
    from millrace.llm.work import Work, scratch

    docs = table(spark, [(k, " ".join(f"w{k % 7}x{j}" for j in range(50))) for k in range(30)])
    base = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(base.iterdir())
    work = Work(spark, "own")
    with scratch():
        out = work.keep(corpus_pipeline.near(spark, docs, ""))
    assert out.count() == 7 and {p.name for p in set(base.iterdir()) - before} == {work.path.rsplit("/", 1)[1]}
