"""The review: an ordered fold of actions per finding, summaries, and the order in which findings are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = "status not in ('removed', 'suggested')"
#: action -> (status it needs or null, optional it needs or null, new status)
STATE = "struct<status:string,optional:boolean,first:string,ok:int,refused:int>"


def is_active(status: Column) -> Column:
    return ~status.isin("removed", "suggested")


def transition(status: Column, optional: Column, first: Column, action: Column) -> Column:
    """The new status, or null where the action is refused."""
    active = is_active(status)
    return (
        F.when((action == "remove") & ~optional & active, "removed")
        .when((action == "restore") & (status == "removed"), F.when(first == "added", "added").otherwise("proposed"))
        .when((action == "apply") & optional & (status == "suggested"), "proposed")
        .when((action == "skip") & optional & (status == "proposed"), "suggested")
        .when((action == "resize") & active, status)
    )


def refusal(status: Column, optional: Column, action: Column) -> Column:
    """Error code of an action that is refused."""
    active = is_active(status)
    return (
        F.when((action == "remove") & optional, "optional").when((action == "remove") & ~active, "already_removed")
        .when((action == "restore") & (status != "removed"), "not_removed")
        .when(action.isin("apply", "skip") & ~optional, "not_optional").when((action == "apply") & (status != "suggested"), "not_suggested")
        .when((action == "skip") & (status != "proposed"), "not_applied")
        .when((action == "resize") & (status == "removed"), "removed").when((action == "resize") & ~active, "not_applied")
    )


def fold_actions(findings: DataFrame, actions: DataFrame, key: str = "id") -> DataFrame:
    """(key, status, applied, refused): each finding's state after its actions in order of (ts, seq). The actions of one finding
    are folded natively; a finding has few, whatever the size of the table."""
    own = actions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "action"))).alias("_a"))
    start = F.struct("status", F.lit(0).alias("ok"), F.lit(0).alias("no"))

    def step(acc: Column, a: Column) -> Column:
        new = transition(acc["status"], F.col("optional"), F.col("first_action"), a["action"])
        return F.struct(F.coalesce(new, acc["status"]).alias("status"), (acc["ok"] + new.isNotNull().cast("int")).alias("ok"), (acc["no"] + new.isNull().cast("int")).alias("no"))

    out = findings.join(own, key, "left").withColumn("_r", F.aggregate(F.coalesce("_a", F.array().cast("array<struct<ts:timestamp,seq:bigint,action:string>>")), start, step))
    return out.select(key, F.col("_r.status").alias("status"), F.col("_r.ok").alias("applied"), F.col("_r.no").alias("refused"))


def apply_optional(findings: DataFrame, as_of: str, reason: str | None = None) -> DataFrame:
    """All suggestions (of a reason) become proposed, with a history entry."""
    hit = F.col("optional") & (F.col("status") == "suggested") & (F.lit(True) if reason is None else F.col("optional_reason") == reason)
    entry = F.struct(F.lit(as_of).alias("at"), F.lit("applied").alias("action"))
    return findings.withColumns({"history": F.when(hit, F.array_append("history", entry)).otherwise(F.col("history")), "status": F.when(hit, "proposed").otherwise(F.col("status"))})


def file_status(status: Column, event: str) -> Column:
    """States of a file: queued, processing, ready, confirmed, exported; error and cancelled are side exits. Null: refused."""
    moves = {
        "edit": F.when(status.isin("ready", "confirmed", "exported"), "ready"), "confirm": F.when(status == "ready", "confirmed"), "export": F.when(status.isin("confirmed", "exported"), "exported"),
        "process": F.when(status.isin("queued", "cancelled", "ready", "error"), "processing"), "cancel": F.when(status.isin("queued", "processing"), "cancelled"),
    }
    return moves[event]


def summary(findings: DataFrame) -> DataFrame:
    """Counts per file."""
    n = lambda c: F.count_if(F.expr(c))
    return findings.groupBy("file").agg(
        n(ACTIVE).alias("total"), n(f"doubtful and {ACTIVE}").alias("doubtful"), n("status = 'removed'").alias("removed"), n("status = 'added'").alias("added"),
        n("status = 'suggested'").alias("suggested"), n("status = 'suggested' and optional_reason = 'url'").alias("suggested_url"), n("status = 'suggested' and optional_reason = 'rut'").alias("suggested_rut"),
    )


def js_round(c: Column) -> Column:
    return F.floor(c + 0.5)


def review_order() -> list[Column]:
    """Doubtful first, then certain, then optional; each by page and place."""
    group = F.when(F.col("optional"), 2).when(F.col("doubtful"), 0).otherwise(1)
    return [group.asc(), F.col("page").asc(), js_round(F.col("y")).asc(), js_round(F.col("x")).asc(), F.col("id").asc()]


def ordered(findings: DataFrame, hidden: list[str] | None = None) -> DataFrame:
    """Findings with their place in the review of their file, and the ids before and after."""
    own = findings.where(~F.col("type").isin(*hidden)) if hidden else findings
    w = Window.partitionBy("file").orderBy(*review_order())
    return own.withColumns({"place": F.row_number().over(w), "previous_id": F.lag("id").over(w), "next_id": F.lead("id").over(w)})


def zone_counts(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """Active findings of every page, zeros included."""
    n = findings.where(ACTIVE).groupBy("file", "page").agg(F.count("*").alias("zones"))
    return pages.select("file", "page").distinct().join(n, ["file", "page"], "left").withColumn("zones", F.coalesce("zones", F.lit(0)))


def page_versions(findings: DataFrame) -> DataFrame:
    """A hash of each page's active findings that does not depend on their order."""
    return findings.where(ACTIVE).groupBy("file", "page").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "id", "type", F.col("x").cast("string"), F.col("y").cast("string")))), ";"), 256).alias("version"))


def plan_queue(jobs: DataFrame, centre: str, partition: list[str]) -> DataFrame:
    """Rendering jobs ranked: kind, in view first, then by distance from the centre, side and number."""
    rank = F.when(F.col("kind") == "page", 0).when(F.col("kind") == "after", 1).otherwise(2)
    w = Window.partitionBy(*partition).orderBy(rank, F.desc("in_view"), F.abs(F.col("row") - F.col(centre)), F.col("row") < F.col(centre), "job")
    return jobs.withColumn("turn", F.row_number().over(w))


def release_plan(loaded: DataFrame, partition: list[str], budget: float) -> DataFrame:
    """What is released, farthest first, until the rest fits the budget."""
    w = Window.partitionBy(*partition).orderBy(F.desc("dist"), F.desc("row"))
    before = F.coalesce(F.sum("mp").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("mp").over(Window.partitionBy(*partition))
    return loaded.withColumn("_over", total - before > budget).where("_over").drop("_over")


def nearest_row(rows: DataFrame, partition: list[str], at: Column) -> DataFrame:
    """The row next to a point, the first of equal ones."""
    dist = F.greatest(F.col("y0") - at, at - F.col("y1"), F.lit(0))
    return rows.groupBy(*partition).agg(F.min_by("row", F.struct(dist, "row")).alias("row"))


def erase_actions(findings: DataFrame, box: dict[str, Column]) -> DataFrame:
    """What erasing a rectangle does to the active zones that it touches."""
    hit = (F.col("x0") < box["x1"]) & (box["x0"] < F.col("x1")) & (F.col("y0") < box["y1"]) & (box["y0"] < F.col("y1"))
    return findings.where(F.expr(ACTIVE) & hit).withColumn("action", F.when(F.col("optional"), "skip").otherwise("remove"))


def place_labels(items: DataFrame, keys: list[str], height: float = 16.0, width: float = 80.0) -> DataFrame:
    """Greedy placement of labels: each above its zone, moved down while it meets an earlier label.

    A taken place stays taken, so zones of one abscissa whose steps fall together (equal remainders of their top by the
    height) begin where the last of them ended. Places are kept in order of their top, by columns a label wide: a label looks at three
    columns, from where it begins."""
    import numpy as np
    import pandas as pd

    class Column:
        """Places of the labels of one column, in order of their tops."""

        def __init__(self) -> None:
            self.n, self.y, self.x = 0, np.empty(16), np.empty(16)

        def add(self, x: float, y: float) -> None:
            if self.n == len(self.y):
                self.y, self.x = (np.concatenate([v, np.empty(len(v))]) for v in (self.y, self.x))
            at = int(np.searchsorted(self.y[: self.n], y))
            for own, v in ((self.y, y), (self.x, x)):
                own[at + 1 : self.n + 1] = own[at : self.n]
                own[at] = v
            self.n += 1

        def beside(self, x: float, start: float) -> np.ndarray:
            """Tops, from ``start`` less a height on, of the labels that a label at x could meet."""
            at = int(np.searchsorted(self.y[: self.n], start - height, side="right"))
            return self.y[at : self.n][np.abs(self.x[at : self.n] - x) < width]

    def place(df: pd.DataFrame) -> pd.DataFrame:
        columns: dict[float, Column] = {}
        done: dict[tuple[float, float], float] = {}
        df = df.sort_values(["y", "x", "id"])
        tops = []
        for x, top in zip(df["x"].to_numpy(dtype=float), df["y"].to_numpy(dtype=float), strict=True):
            y = max(0.0, top - height)
            steps = (x, y % height)
            y = max(y, done.get(steps, y))
            c = x // width
            met = [columns[k].beside(x, y) for k in (c - 1, c, c + 1) if k in columns]
            met = np.concatenate(met) if met else np.empty(0)
            if len(met):
                first = np.floor((met - y) / height).astype(np.int64)
                taken = np.zeros(int(first.max()) + 4, dtype=bool)
                for k in (-1, 0, 1, 2):
                    at = first + k
                    hit = (at >= 0) & (np.abs(y + at * height - met) < height)
                    taken[at[hit]] = True
                y += int(np.argmin(taken)) * height
            done[steps] = y
            columns.setdefault(c, Column()).add(x, y)
            tops.append(y)
        return df[[*keys, "id"]].assign(label_y=tops)

    kinds = dict(items.dtypes)
    return items.groupBy(*keys).applyInPandas(place, ", ".join(f"{c} {kinds[c]}" for c in [*keys, "id"]) + ", label_y double")
