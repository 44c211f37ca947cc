from . import brute
from pyspark.sql import functions as F

from signalmill.llm import quality_rules as Q

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept"]


def body(i, n=80):
    return " ".join(f"w{i}x{j}" for j in range(n))


def rows_of(df):
    return {r.doc_id: tuple(r[c] for c in COUNTS) for r in df.collect()}


def test_counts_and_frequent_lines(documents):
    common = "All Rights   reserved by the makers of this page"
    rows = [(i, "a", f"{body(i)}\n{common if i % 2 else common.lower()}") for i in range(30)]
    rows += [(100 + i, "a", f"{common} {'z ' * 30}\n{common}\n" + "q w e r t y " * 20) for i in range(3)]
    rows += [(200 + i, "b", f"{body(i)}\n{common}") for i in range(20)]
    rows += [(300, "a", "short"), (301, None, body(7)), (302, "a", "a b c d a b c x " * 9)]
    assert rows_of(Q.quality_rules(documents(rows))) == brute.quality(rows)


def test_copies_count_once_and_depleted_go(documents):
    line = "this very line stands on every page of the host and is long enough to fill it up with words again"
    rows = [(i, "a", f"{line}\n{' '.join(f'r{i}x{j}' for j in range(8))}\n{line} x{i}\n" + f"{body(i, 40)}") for i in range(30)]
    copies = [(100 + i, "b", f"{body(1)}\n{line}") for i in range(60)]
    thin = [(200 + i, "c", "\n".join([line + " " + w for w in "abcdefgh"]) + f"\nown{i}") for i in range(30)]
    got = rows_of(Q.quality_rules(documents(rows + copies + thin)))
    assert got == brute.quality(rows + copies + thin)
    assert all(got[d][-1] for d, _, _ in copies) and not any(got[d][-1] for d, _, _ in thin)


def test_apply_takes_lines_out(documents):
    line = "Subscribe to our news letter today"
    rows = [(i, "a", f"{body(i)}\n{line}\n{body(i + 1000)}") for i in range(30)]
    out = Q.apply_quality(documents(rows).withColumn("__host", F.lit(1)).withColumn("kept", F.lit("k"))).collect()
    assert {r.doc_id: r.text for r in out} == {i: f"{body(i)}\n{body(i + 1000)}" for i in range(30)}
    assert all(r.n_chars == len(r.text) and r.kept == "k" for r in out)


def test_edges(edges):
    rows, df = edges
    out = Q.quality_rules(df.withColumn("n_words", F.lit("clash")).withColumn("__text", F.lit(0)))
    want = brute.quality([(i, s, t) for i, (_, s, t) in enumerate(rows)])
    assert sorted(str((r.doc_id, *[r[c] for c in COUNTS])) for r in out.collect()) == sorted(str((rows[i][0], *v)) for i, v in want.items())
    kept = Q.apply_quality(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {5, 6}


def test_empty_table(documents):
    assert Q.quality_rules(documents([])).collect() == [] and Q.apply_quality(documents([])).collect() == []


def test_the_query(spark, folder, sample):
    assert rows_of(Q.op7_quality_rules(spark, folder)) == brute.quality(sample[0])
