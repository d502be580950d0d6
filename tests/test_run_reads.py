"""Scores of reads that no fold takes are left out before anything is summed or moved."""

from lumipep import run
from lumipep.run import Checks, Settings


def test_scores_of_other_reads_go_no_further(spark, monkeypatch):
    seen, plain = [], run.scores.with_residual
    monkeypatch.setattr(run.scores, "with_residual", lambda kept, n: seen.append(kept) or plain(kept, n))
    reads = range(40)
    tables = {
        "emission": spark.createDataFrame([(p, p, 0.75) for p in range(4)] + [(p, (p + 1) % 4, 0.25) for p in range(4)], "protein_id int, flu_id int, p double"),
        "protein": spark.createDataFrame([(p, 1.0) for p in range(4)], "protein_id int, exp_n double"),
        "scores": spark.createDataFrame([(r, (r + j) % 4, 0.6 - j / 4) for r in reads for j in range(2)], "read_id long, flu_id int, s double"),
        "cv_reads": spark.createDataFrame([(cv, r) for cv in range(2) for r in (3, 5, 5 + cv, 21)], "cv int, read_id long").distinct(),
        "cv_truth": spark.createDataFrame([(cv, p, 0.25) for cv in range(2) for p in range(4)], "cv int, protein_id int, p_y double"),
    }
    for n_best in (None, 1):
        checks = Checks()
        fit, _ = run.fitted(tables, Settings(2, n_best=n_best), checks=checks)
        assert {r["read_id"] for r in seen.pop().collect()} == {3, 5, 6, 21}
        assert checks.found()["scores.rows"] == 80  # all rows are still looked at
        whole = dict(tables, scores=tables["scores"].filter("read_id in (3, 5, 6, 21)"))
        want = run.fitted(whole, Settings(2, n_best=n_best))[0].pi
        seen.clear()
        assert {(r["cv"], r["protein_id"]): round(r["pi"], 12) for r in fit.pi.collect()} == {(r["cv"], r["protein_id"]): round(r["pi"], 12) for r in want.collect()}
