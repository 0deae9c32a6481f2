import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from switchyard import schema as S
from switchyard.operators import cells, cleaning, costs, profile, ranking, split
from switchyard.session import scratch_path
from switchyard.sources import messages as files
from switchyard.sources import results as res


def skewed_rows(n=600, seed=3):
    """A third of all rows carry one text and one stratum."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.34
        text = "same text" if hot else f"text {rng.randint(0, 150)}"
        rows.append((i, text, "en" if hot else rng.choice(["de", "fr"]), "x", rng.choice(["s", "p"]), int(hot)))
    return rows


COLUMNS = "doc_id long, text string, language string, industry string, scenario string, label int"


def test_dedup_keeps_first_and_is_idempotent(spark):
    rows = skewed_rows()
    first = {}
    for r in rows:
        first.setdefault(r[1], r[0])
    once = cleaning.dedup_exact(spark.createDataFrame(rows, COLUMNS).repartition(7))
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(first.values())
    assert cleaning.dedup_exact(once).count() == len(first)
    counts = cleaning.dedup_counts(spark.createDataFrame(rows, COLUMNS)).first()
    assert (counts["rows"], counts["kept"], counts["dropped"]) == (600, len(first), 600 - len(first))


def test_cell_counters(spark):
    rows = [(1, " a ", "l", "i", "s", 0), (2, "a", "l", "i", "s", 0), (3, "  ", "l", "i", "s", 0), (4, "a", "m", "i", "s", 0)]
    got = {r["cell_id"]: (r["seen"], r["empty"], r["dupes"], r["kept"])
           for r in cleaning.cell_dedup_counters(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {"l__i__s": (3, 1, 1, 1), "m__i__s": (1, 0, 0, 1)}
    kept = cleaning.dedup_within_cells(spark.createDataFrame(rows, COLUMNS)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, "a"), (4, "a")]


@pytest.mark.parametrize("prefix", [1, 2, 3])
def test_stratified_split_quotas(spark, prefix):
    import hashlib

    rows = skewed_rows()
    strata = defaultdict(list)
    for r in rows:
        strata[(r[5], r[4])].append(r[0])
    want = {}
    for ids in strata.values():
        ids.sort(key=lambda i: (hashlib.md5(f"42|{i}".encode()).hexdigest(), i))
        for rank, i in enumerate(ids, 1):
            want[i] = "train" if rank * 10 <= len(ids) * 8 else "val" if rank * 10 <= len(ids) * 9 else "test"
    got = split.stratified_split(spark.createDataFrame(rows, COLUMNS), prefix=prefix)
    assert {r["doc_id"]: r["split"] for r in got.collect()} == want
    assert {r["shared"] for r in split.pairwise_overlap(got, F.col("doc_id")).collect()} == {0}


def test_tiny_strata_split(spark):
    rows = [(1, "a", "l", "i", "s", 0), (2, "b", "l", "i", "s", 1), (3, "c", "l", "i", "s", 1)]
    got = split.stratified_split(spark.createDataFrame(rows, COLUMNS))
    assert Counter(r["split"] for r in got.collect()) == {"test": 2, "train": 1}


def test_validation_requires_columns_and_drops_bad_rows(spark):
    rows = spark.createDataFrame([("x", 1, "train"), (None, 1, "train"), (" ", 0, "val"), ("y", None, "val")],
                                 "text string, label long, split string")
    assert [(r["text"], r["label"]) for r in cleaning.validate_and_clean(rows).collect()] == [("x", 1)]
    dropped = {r["split"]: (r["before"], r["after"], r["dropped"]) for r in cleaning.dropped_rows(rows).collect()}
    assert dropped == {"train": (2, 1, 1), "val": (2, 0, 2)}
    with pytest.raises(ValueError):
        cleaning.validate_and_clean(rows.drop("label"))


def test_plan_rounding_gaps_and_resume(spark):
    plan = spark.createDataFrame(
        [("a", "i", "s", 0.5, 0.5, 0.5), ("a", "i", "p", 0.5, 0.5, 0.5), ("a", "j", "s", 0.5, 0.5, 1.0), ("b", "i", "s", 0.5, 1.0, 1.0)],
        "language string, industry string, scenario string, language_fraction double, industry_fraction double, scenario_fraction double",
    )
    counts = cells.plan_counts(plan, 10)
    want = {("a", "i", "s"): round(round(round(10 * 0.5) * 0.5) * 0.5), ("a", "j", "s"): round(round(10 * 0.5) * 0.5)}
    got = {(r["language"], r["industry"], r["scenario"]): r["target_count"] for r in counts.collect()}
    assert got[("a", "i", "s")] == want[("a", "i", "s")] and got[("a", "j", "s")] == want[("a", "j", "s")]
    assert cells.plan_violations(plan).count() == 0
    todo = cells.to_cells(counts)
    have = spark.createDataFrame([("b", "i", "s")] * 3, "language string, industry string, scenario string")
    assert "b__i__s" not in {r["cell_id"] for r in cells.remaining_cells(todo, have).collect()}
    gaps = {r["cell_id"]: (r["rows"], r["missing"]) for r in cells.gaps(todo, have).collect()}
    assert gaps["b__i__s"] == (3, 2)
    assert cells.total_missing(cells.gaps(todo, have)).first()["missing"] == sum(m for _, m in gaps.values())


def test_default_plan_adds_up(spark):
    plan = cells.default_plan(spark)
    assert cells.plan_violations(plan).count() == 0
    todo = cells.to_cells(cells.plan_counts(plan))
    assert todo.count() == len(S.LANGUAGES) * len(S.INDUSTRIES) * len(S.SCENARIOS) == 80
    assert {r["label"]: r["planned"] for r in cells.planned_labels(todo).collect()} == {0: 30_034, 1: 29_966}


def test_histogram_of_one_value_and_box(spark):
    rows = spark.createDataFrame([(0, 5, "a")] * 3 + [(1, v, "b") for v in (1, 2, 3, 100)], "label int, word_count int, language string")
    bins = {(r["label"], r["bin"]): r["rows"] for r in profile.histogram(rows).collect()}
    assert bins[(0, 20)] == 3 and bins[(1, 0)] == 3 and bins[(1, 39)] == 1
    box = {r["language"]: r for r in profile.box_stats(rows).collect()}
    assert (box["b"]["whisker_high"], box["b"]["outliers"]) == (3, 1)


def test_missing_split_reads_empty(spark):
    path = scratch_path(spark, "t")
    rows = spark.createDataFrame([("x", "l", "i", "s", 1, 1, "train")],
                                 "text string, language string, industry string, scenario string, label int, word_count int, split string")
    files.write_dataset(rows, path, "v1")
    assert files.read_split(spark, path, "v1", "train").count() == 1
    assert files.read_split(spark, path, "v1", "val").count() == 0
    assert files.read_split_csv(spark, path + "/nothing.csv").count() == 0
    assert [r[0] for r in files.list_datasets(spark.read.parquet(path)).collect()] == ["v1"]


def test_csv_keeps_awkward_texts(spark):
    texts = ['say "hi"', "two\nlines", " outer blanks ", "comma, semi;", "back\\slash", "ශාඛාව"]
    rows = spark.createDataFrame([(t, "l", "i", "s", 1, 1) for t in texts], S.MESSAGE)
    path = scratch_path(spark, "csv")
    files.write_messages(rows, path)
    assert sorted(r["text"] for r in files.read_messages(spark, path).collect()) == sorted(texts)


def test_results_flat_nested_and_broken(spark):
    docs = [
        '{"experiment_id": "a", "approach": "classical", "recall_1": 0.9, "mcc": 0.5}',
        '{"experiment_id": "b", "approach": "transformer", "metrics": {"recall_1": 0.8}}',
        '{"vectorizer_key": "v", "classifier_key": "c", "recall_1": 0.7}',
        "{broken", None,
    ]
    raw = spark.createDataFrame([(d,) for d in docs], "json string")
    flat = res.flatten_results(res.normalise_results(res.parse_results(raw), "v9"))
    got = {r["experiment_id"]: (r["approach"], r["recall_1"], r["mcc"], r["dataset_name"]) for r in flat.collect()}
    assert got == {"a": ("classical", 0.9, 0.5, "v9"), "b": ("transformer", 0.8, 0.0, "v9"), "v__c": ("classical", 0.7, 0.0, "v9")}


def test_best_model_rules(spark):
    rows = spark.createDataFrame(
        [("a", 0.95, 0.6, 3.0), ("b", 0.93, 0.8, 9.0), ("c", 0.92, 0.8, 2.0), ("d", 0.5, 0.99, 1.0)],
        "experiment_id string, recall_1 double, mcc double, latency_p50_ms double",
    )
    assert ranking.best_model(rows).first()["experiment_id"] == "c"
    assert ranking.best_model(rows, 0.99).first()["experiment_id"] == "a"
    assert [r["experiment_id"] for r in ranking.comparison_table(rows).collect()] == ["a", "b", "c", "d"]


def test_costs(spark):
    rows = spark.createDataFrame([("a", 50, 10, 10, 30, 0.83, 0.75)],
                                 "experiment_id string, tp long, fp long, fn long, tn long, recall_1 double, precision_0 double")
    table = {r["strategy"]: r for r in costs.cost_table(rows).collect()}
    assert table["all_strong"]["cost_usd"] == pytest.approx(100 * costs.Prices().strong)
    assert table["all_cheap"]["cost_usd"] == pytest.approx(100 * costs.Prices().cheap)
    assert table["router_a"]["pct_cheap"] == pytest.approx(0.4)
    estimate = {r["strategy"]: r for r in costs.cost_table(rows, "estimate").collect()}
    assert estimate["router_a"]["pct_cheap"] == pytest.approx(0.75 * (1 - 0.83))


def test_histogram_has_every_bin_of_every_group(spark):
    rows = spark.createDataFrame([(1, 5), (1, 45), (None, 7), (None, 7)], "label int, word_count int")
    got = {}
    for r in profile.histogram(rows, bins=10).collect():
        got.setdefault(r["label"], []).append((r["bin"], r["rows"]))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {
        1: [1, 0, 0, 0, 0, 0, 0, 0, 0, 1], None: [0, 0, 0, 0, 0, 2, 0, 0, 0, 0],
    }


def test_null_groups_stay_in_profiles(spark):
    rows = spark.createDataFrame([(None, "a", 1, 3), ("train", None, 0, 4)], "split string, language string, label int, word_count int")
    rows = rows.withColumn("scenario", F.lit("s"))
    assert {r["split"] for r in profile.split_documents(rows).collect()} == {None, "train"}
    assert {r["language"] for r in profile.box_stats(rows).collect()} == {None, "a"}


def test_null_strata_are_split_80_10_10(spark):
    rows = spark.range(40).selectExpr("id AS doc_id", "if(id < 20, null, 1) AS label", "'s' AS scenario")
    got = {(r["label"], r["split"]): r["count"] for r in split.stratified_split(rows).groupBy("label", "split").count().collect()}
    assert got == {(k, s): n for k in (None, 1) for s, n in (("train", 16), ("val", 2), ("test", 2))}


def test_csv_columns_are_read_by_name_and_only_absence_is_empty(spark, tmp_path):
    (tmp_path / "a.csv").write_text('language,text,industry,scenario,label,word_count\nen,"hi\nthere",x,y,1,2\n')
    row = files.read_messages(spark, str(tmp_path / "a.csv")).first()
    assert (row["text"], row["language"], row["label"]) == ("hi\nthere", "en", 1)
    assert files.read_split_csv(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "b.csv").write_text("language\nen\n")
    with pytest.raises(Exception, match="text"):
        files.read_split_csv(spark, str(tmp_path / "b.csv")).count()


def test_dedup_keeps_smallest_id_without_sorting_texts(spark):
    rows = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None), (5, None)], "doc_id long, text string")
    kept = cleaning.dedup_exact(rows)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4]
    assert "SortAggregate" not in kept._jdf.queryExecution().toString()


def test_dedup_leaves_one_row_per_text_when_ids_repeat_or_are_null(spark):
    rows = [(7, "same", "a")] * 40 + [(9, "same", "a")] * 5 + [(None, "same", "a")] * 5
    rows += [(None, "no id", "a")] * 30 + [(None, None, "a")] * 3 + [(5, None, "a")] * 2
    rows += [(1, "x", "a"), (1, "y", "b"), (1, "y", "c"), (None, "z", "a"), (2, "z", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    kept = cleaning.dedup_exact(df)
    got = kept.collect()
    want = {"same": 7, "no id": None, None: 5, "x": 1, "y": 1, "z": 2}
    assert len(got) == len(want) and {r.text: r.doc_id for r in got} == want
    assert all(tuple(r) in rows for r in got)
    assert cleaning.dedup_counts(df).first()["kept"] == len(want)
    assert "WindowGroupLimit" in kept._jdf.queryExecution().toString()
    messages = df.where("text IS NOT NULL").selectExpr("*", "'l' AS language", "'i' AS industry", "'s' AS scenario")
    assert sorted(r.text for r in cleaning.dedup_within_cells(messages).collect()) == sorted(t for t in want if t)
