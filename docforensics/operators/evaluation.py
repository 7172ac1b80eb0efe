"""Model scores: labels, calibration, reports, thresholds, splits, and suspicious zones of attribution cells."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .ranges import running

#: Threshold of the label; it holds for the raw probability.
THRESHOLD = 0.54


def classify(prob: Column, threshold: float = THRESHOLD) -> Column:
    return F.when(prob.isNull(), "Unknown").when(prob >= threshold, "Falsified").otherwise("Real")


def temperature_scale(prob: Column, temperature: float) -> Column:
    t = temperature if temperature > 0 else 1.0
    p = F.least(F.greatest(prob, F.lit(1e-6)), F.lit(1 - 1e-6))
    return prob if abs(t - 1) <= 1e-9 else 1 / (1 + F.exp(-F.log(p / (1 - p)) / t))


def confidence(label: Column, calibrated: Column) -> Column:
    return F.when(label == "Falsified", calibrated).when(label == "Real", 1 - calibrated).otherwise(0.0)


def risk_level(label: Column, conf: Column) -> Column:
    c = F.least(F.greatest(conf, F.lit(0.0)), F.lit(1.0))
    fake = F.when(c >= 0.8, "High").when(c >= 0.5, "Medium").otherwise("Low")
    real = F.when(c >= 0.8, "Low").when(c >= 0.5, "Medium").otherwise("High")
    return F.when(label == "Falsified", fake).when(label == "Real", real).otherwise("High")


def classification_report(scored: DataFrame, truth: str, predicted: str) -> DataFrame:
    """name (each class, accuracy, macro avg, weighted avg), precision, recall, f1, support; 4 decimals.

    The accuracy stands under f1. Only the counts of (truth, prediction) are worked with.
    """
    counts = scored.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = counts.select(F.col("t").alias("name"), F.col("n").alias("support"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit"), F.lit(0).alias("called"))
    sides = sides.union(counts.select("p", F.lit(0), F.lit(0), "n"))
    each = sides.groupBy("name").agg(F.sum("support").alias("support"), F.sum("hit").alias("hit"), F.sum("called").alias("called"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    each = each.select("name", "support", "hit", ratio(F.col("hit"), F.col("called")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"))
    each = each.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).where("support > 0")
    measures = ("precision", "recall", "f1")
    r4 = lambda c, k: F.round(c, 4).alias(k)
    rows = each.select("name", *(r4(F.col(k), k) for k in measures), "support")
    none = F.lit(None).cast("double")
    rows = rows.union(each.agg(F.lit("accuracy"), none, none, r4(F.sum("hit") / F.sum("support"), "f1"), F.sum("support")))
    rows = rows.union(each.agg(F.lit("macro avg"), *(r4(F.avg(k), k) for k in measures), F.sum("support")))
    return rows.union(each.agg(F.lit("weighted avg"), *(r4(F.sum(F.col(k) * F.col("support")) / F.sum("support"), k) for k in measures), F.sum("support")))




def by_score(scored: DataFrame, prob: str, truth: str, ranges: int | None = None) -> DataFrame:
    """Positives and rows at each score and at or above it; rows without a score come last.

    Rows are added up by distinct score once. Their sums run in ranges of scores that a sample cuts, as
    many as there are shuffle partitions, and are carried from range to range.
    """
    at = scored.groupBy(F.col(prob).alias("score")).agg(F.coalesce(F.sum(F.col(truth).cast("bigint")), F.lit(0)).alias("pos"), F.count("*").alias("n"))
    return running(at, [], [F.desc_nulls_last("score")], {"tp": F.col("pos"), "called": F.col("n")}, ranges)


def best_threshold(scored: DataFrame, prob: str, truth: str) -> DataFrame:
    """The score at which calling it and all above positive gives the greatest F1; ties to the greatest score.

    Rows without a score are never called and so no threshold, but their positives count as missed.
    Without any score there is no row.
    """
    d = by_score(scored, prob, truth)
    total = d.agg(F.sum("pos").alias("total"))
    d = d.where("score is not null").crossJoin(F.broadcast(total))  # one row
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("called") + F.col("total"))).otherwise(0.0)
    return d.select(F.col("score").alias("threshold"), F.round(f1, 6).alias("best_f1")).orderBy(F.desc("best_f1"), F.desc("threshold")).limit(1)


def roc_auc(scored: DataFrame, prob: str, truth: str) -> DataFrame:
    """Area by ranks, ties at their mean rank; rows without a score tie below all others."""
    d = by_score(scored, prob, truth)
    # Rows below plus half of those that tie, for each positive
    total = d.agg(F.sum("n").alias("rows"), F.sum("pos").alias("positives"))
    d = d.crossJoin(F.broadcast(total))  # one row
    below_neg = (F.col("rows") - F.col("positives")) - (F.col("called") - F.col("tp"))
    area = F.sum(F.col("pos") * (below_neg + (F.col("n") - F.col("pos")) / 2.0))
    return d.groupBy("rows", "positives").agg(area.alias("a")).select(F.round(F.col("a") / (F.col("positives") * (F.col("rows") - F.col("positives"))), 6).alias("auc"))


def best_epoch(log: DataFrame, metric: str = "val_auc") -> DataFrame:
    """The epoch of the greatest metric (the first of equals) and the last epoch, with the metric at each."""
    return log.agg(
        F.min_by("epoch", F.struct(-F.col(metric), F.col("epoch"))).alias("best_epoch"), F.max(metric).alias("best"),
        F.max("epoch").alias("last_epoch"), F.max_by(metric, "epoch").alias("last"),
    )


def stratified_split(rows: DataFrame, id_col: str, class_col: str, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """train, val or test for each row, with the shares held in each class.

    Rows of a class are in the order of a hash of their id. A class may hold most rows, so the cut
    is made on counts of the hash's first 12 bits, and ranks are taken within a cell. Rows without a
    class are a class of their own; in a class, rows without an id come first.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    d = rows.withColumn("_h", h).withColumn("_cell", F.shiftright("_h", 20))
    cells = d.groupBy(class_col, "_cell").agg(F.count("*").alias("_m"))
    ahead = Window.partitionBy(class_col).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(class_col, "_cell", F.coalesce(F.sum("_m").over(ahead), F.lit(0)).alias("_before"), F.sum("_m").over(Window.partitionBy(class_col)).alias("_total"))
    cells = cells.withColumnsRenamed({class_col: "_class", "_cell": "_at"})
    d = d.join(cells, F.col(class_col).eqNullSafe(F.col("_class")) & F.col("_cell").eqNullSafe(F.col("_at")))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy(class_col, "_cell").orderBy("_h", id_col))
    share = lambda x: F.round(F.col("_total") * F.lit(Decimal(str(x))))
    part = F.when(rank <= share(train), "train").when(rank <= share(train) + share(val), "val").otherwise("test")
    return d.withColumn("split", part).drop("_h", "_cell", "_class", "_at", "_before", "_total")


def fit_and_score(vectors: DataFrame, vector_col: str, label_col: str, id_col: str, iterations: int = 20) -> DataFrame:
    """id and prob_fake by a logistic regression on the vectors; rows without a vector or a label aren't learned from."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    d = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col), array_to_vector(F.col(vector_col).cast("array<double>")).alias("features"), F.col(label_col).cast("double").alias("label"))
    model = LogisticRegression(maxIter=iterations, regParam=0.01).fit(d.where("label is not null"))
    return model.transform(d).select(id_col, vector_to_array("probability")[1].alias("prob_fake"))


def attention_summary(cells: DataFrame, heat: str = "heat") -> DataFrame:
    """edge, centre, hot-spot or diffuse: means of the outer 15 % and the rest, and the peak."""
    extent = cells.groupBy("scan_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    d = cells.join(extent, "scan_id")
    border = F.greatest(F.lit(1), F.bround(F.least("h", "w") * 0.15, 0).cast("int"))
    edge = (F.col("y") < border) | (F.col("y") >= F.col("h") - border) | (F.col("x") < border) | (F.col("x") >= F.col("w") - border)
    d = d.groupBy("scan_id").agg(F.coalesce(F.avg(F.when(edge, F.col(heat))), F.lit(0.0)).alias("edge"), F.coalesce(F.avg(F.when(~edge, F.col(heat))), F.lit(0.0)).alias("centre"), F.max(heat).alias("peak"))
    kind = F.when(F.col("edge") > F.col("centre") * 1.15, "edge").when(F.col("centre") > F.col("edge") * 1.15, "centre").when(F.col("peak") > 0.85, "hot-spot").otherwise("diffuse")
    return d.withColumn("attention", kind)


def adaptive_thresholds(cells: DataFrame) -> DataFrame:
    """Thresholds of heat and of coefficients for each scan, from exact percentiles."""
    d = cells.groupBy("scan_id").agg(F.percentile("heat", 0.9).alias("p90"), F.percentile(F.when(F.col("coef") > 0.02, F.col("coef")), 0.72).alias("p72"))
    clip = lambda c, a, b: F.least(F.greatest(c, F.lit(a)), F.lit(b))
    return d.select("scan_id", clip(0.5 * 0.55 + 0.5 * F.col("p90"), 0.38, 0.78).alias("heat_threshold"), F.coalesce(clip(0.5 * 0.30 + 0.5 * F.col("p72"), 0.12, 0.50), F.lit(0.30)).alias("coef_threshold"))


def flagged_cells(cells: DataFrame) -> DataFrame:
    d = cells.join(adaptive_thresholds(cells), "scan_id")
    return d.where((F.col("heat") >= F.col("heat_threshold")) | (F.col("coef") >= F.col("coef_threshold"))).drop("heat_threshold", "coef_threshold")


#: Names of the parts of a document, in rows from the top.
ZONES = (("Header / logo area", "Document title area", "Top-right corner"), ("Photo zone", "Name / nationality fields", "ID number zone"), ("Signature / seal area", "Date fields", "MRZ / barcode zone"))


def zone_name(cx: Column, cy: Column) -> Column:
    """The part of a document around a point given as shares of its width and height."""
    names = ZONES
    row = lambda r: F.when(cx < 0.30, r[0]).when(cx < 0.65, r[1]).otherwise(r[2])
    return F.when(cy < 0.25, row(names[0])).when(cy < 0.55, row(names[1])).otherwise(row(names[2]))


def suspicious_zones(cells: DataFrame, top: int = 5, labels: DataFrame | None = None) -> DataFrame:
    """The strongest components of flagged cells in each scan, numbered.

    A component has 0.5 to 70 % of the cells, and its severity (the greatest heat or coefficient
    of all cells in its box, flagged or not) is at least max(0.10, 0.28 of the greatest); the
    strongest stays in any case. Scans that `labels` (scan_id, label) calls Real have no zones.
    """
    if labels is not None:
        cells = cells.join(labels.where("label = 'Real'").select("scan_id").distinct(), "scan_id", "left_anti")
    extent = cells.groupBy("scan_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    boxes = flagged_cells(cells).groupBy("scan_id", "comp_id").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("bw"), (F.max("y") - F.min("y") + 1).alias("bh"), F.count("*").alias("area")
    )
    # A row of a box is joined with the cells of that row: each box meets only its own rows
    bands = boxes.select("scan_id", "comp_id", F.col("x").alias("bx"), "bw", F.explode(F.sequence("y", F.col("y") + F.col("bh") - 1)).alias("y"))
    inside = bands.join(cells.select("scan_id", "y", "x", "heat", "coef"), ["scan_id", "y"]).where("x >= bx and x < bx + bw")
    severity = inside.groupBy("scan_id", "comp_id").agg(F.round(F.greatest(F.max("heat"), F.max("coef"), F.lit(1e-6)), 3).alias("severity"))
    zones = boxes.join(severity, ["scan_id", "comp_id"]).join(extent, "scan_id")
    zones = zones.where((F.col("area") >= F.col("h") * F.col("w") * 0.005) & (F.col("area") <= F.col("h") * F.col("w") * 0.70))
    scan = Window.partitionBy("scan_id")
    zones = zones.withColumn("number", F.row_number().over(scan.orderBy(F.desc("severity"), "comp_id"))).withColumn("_max", F.max("severity").over(scan))
    kept = zones.where(((F.col("severity") >= F.greatest(F.lit(0.10), 0.28 * F.col("_max"))) | (F.col("number") == 1)) & (F.col("number") <= top))
    zone = zone_name((F.col("x") + F.col("bw") / 2) / F.col("w"), (F.col("y") + F.col("bh") / 2) / F.col("h"))
    return kept.select("scan_id", "number", "comp_id", zone.alias("zone"), "severity", "x", "y", F.col("bw").alias("width"), F.col("bh").alias("height"))


def cell_runs(cells: DataFrame) -> DataFrame:
    """scan_id, y, x, x2: the cells of each row that follow each other without a gap, from x to x2."""
    d = cells.select("scan_id", "y", "x").distinct()
    along = F.row_number().over(Window.partitionBy("scan_id", "y").orderBy("x"))
    return d.withColumn("_g", F.col("x") - along).groupBy("scan_id", "y", "_g").agg(F.min("x").alias("x"), F.max("x").alias("x2")).drop("_g")


def _meeting(runs: DataFrame) -> DataFrame:
    """scan_id, u, v: runs of neighbouring rows that touch, also at corners, as (y, x) of their starts; enough of them that all touching runs are connected.

    Runs of a row are apart, so of two that touch, one is the last of its row that touches the other. A run
    therefore meets the last run of the row below and above that starts by its end: a running
    maximum over the starts and ends of both rows, with no pairs of runs.
    """
    me = F.struct("y", "x")
    events = [
        runs.select("scan_id", (F.col("y") - side).alias("pair"), F.lit(side).alias("side"), me.alias("run"), F.col("x").alias("a"), F.col("x2").alias("b"), F.explode(F.array(F.struct(F.col("x").alias("at"), F.lit(0).alias("asks")), F.struct((F.col("x2") + 1).alias("at"), F.lit(1).alias("asks")))).alias("e"))
        for side in (0, 1)
    ]
    d = events[0].unionByName(events[1]).select("scan_id", "pair", "side", "run", "a", "b", "e.*")
    so_far = Window.partitionBy("scan_id", "pair").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = {side: F.last(F.when((F.col("side") == side) & (F.col("asks") == 0), F.struct("run", "b")), ignorenulls=True).over(so_far) for side in (0, 1)}
    d = d.select("scan_id", "run", "a", "asks", F.when(F.col("side") == 0, last[1]).otherwise(last[0]).alias("other")).where("asks = 1 and other.b >= a - 1")
    return d.select("scan_id", F.greatest("run", "other.run").alias("u"), F.least("run", "other.run").alias("v"))


def connected_cells(cells: DataFrame) -> DataFrame:
    """comp_id (y, x) for each cell given: the first cell, by row and column, that a chain of 8-neighbours reaches; each cell once.

    Cells are joined to runs along x first. Runs that touch are edges of a graph, and its components
    are found by stars: all neighbours of a run are linked to the smallest of them, first the larger
    and then the smaller ones, until nothing changes; each round is cut off by a checkpoint.
    """
    runs = cut(cell_runs(cells))
    edges = cut(_meeting(runs).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select("scan_id", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("scan_id", "u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, ["scan_id", "u"]).where("v > u").select("scan_id", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u > v")
        least = down.groupBy("scan_id", "u").agg(F.min("v").alias("m"))
        small = down.join(least, ["scan_id", "u"]).select("scan_id", F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("scan_id", "e.*").where("u > v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("scan_id", "u", "v").cast("decimal(38, 0)"))).first()
        if now == state:
            break
        state = now
    named = runs.withColumn("u", F.struct("y", "x")).join(edges, ["scan_id", "u"], "left").select("scan_id", "y", F.explode(F.sequence("x", "x2")).alias("x"), F.coalesce("v", "u").alias("comp_id"))
    return named


def relabel_zones_iou(zones: DataFrame, boxes: DataFrame, page: DataFrame, side: int = 384) -> DataFrame:
    """Zones named after the photo or field box that they overlap most: intersection over union of at least 0.12.

    boxes: scan_id, name, x, y, w, h in the page's own pixels; page: scan_id, page_w, page_h. The
    photo comes before fields of the same overlap, then names in order.
    """
    b = boxes.join(page, "scan_id").where("w > 0 and page_w > 0 and page_h > 0")
    scaled = b.select(
        "scan_id", "name", F.floor(F.col("x") * side / F.col("page_w")).alias("bx"), F.floor(F.col("y") * side / F.col("page_h")).alias("by"),
        F.greatest(F.lit(1), F.floor(F.col("w") * side / F.col("page_w"))).alias("bw"), F.greatest(F.lit(1), F.floor(F.col("h") * side / F.col("page_h"))).alias("bh"),
    )
    d = zones.where("width > 0 and height > 0").join(scaled, "scan_id")
    iw = F.greatest(F.lit(0), F.least(F.col("x") + F.col("width"), F.col("bx") + F.col("bw")) - F.greatest("x", "bx"))
    ih = F.greatest(F.lit(0), F.least(F.col("y") + F.col("height"), F.col("by") + F.col("bh")) - F.greatest("y", "by"))
    both = iw * ih
    iou = both / (F.col("width") * F.col("height") + F.col("bw") * F.col("bh") - both)
    best = d.withColumn("iou", iou).where("iou >= 0.12").groupBy("scan_id", "number").agg(F.min_by("name", F.struct(-F.col("iou"), F.col("name") != "photo", F.col("name"))).alias("label"))
    return zones.join(best, ["scan_id", "number"], "left").withColumn("zone", F.coalesce("label", "zone")).drop("label")
