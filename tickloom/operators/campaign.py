"""Many searches side by side: each window of a walk-forward, under each combination of fitness weights, has a population of
its own, and all populations go on together, a generation of all of them at a time.

What an individual earns on a window doesn't depend on the weights, so a run is a window and a genome, evaluated once
whoever asks. A generation's new runs are one signal table, one simulation and one set of metrics, whatever the number
of windows; the metrics are appended to a log. Searches depend on seeds and scores alone, so the log is also their
checkpoint: a campaign that broke off begins anew, and finds all that it had evaluated there.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import stored
from ..schema import Strategy, duration
from . import metrics as M
from .search import Chromosome, SearchParams, evolution, walk_forward_report
from .signals import signal_matrix
from .simulate import equity, simulate, trades

#: Weights of win rate, profit factor, return and one-sidedness.
Weights = tuple[float, float, float, float]
USUAL: Weights = (0.15, 5.0, 50.0, 10.0)
#: Strategies of one signal plan; more are more plans, all in one table.
STRATEGIES = 200
MISSING = -1000.0

METRICS = (
    "run_id string, total_trades long, winning long, gain double, loss double, pnl double, longs long, sharpe double, win_rate double, "
    "total_return double, max_drawdown double"
)
REPORT = (
    "rank int, window int, train_start timestamp_ntz, train_end timestamp_ntz, val_start timestamp_ntz, val_end timestamp_ntz, "
    "fitness double, train_sharpe double, val_sharpe double, val_win_rate double, val_total_return double, champion string"
)


@dataclass(frozen=True)
class Run:
    """A strategy on the bars that begin from `start` up to, not with, `end`; its name is the run's."""

    strategy: Strategy
    start: object
    end: object


def genome(person: Chromosome) -> str:
    """A name for what an individual does: equal ones have equal names."""
    return hashlib.sha256(json.dumps(asdict(person.decode("")), sort_keys=True, default=str).encode()).hexdigest()[:20]


def evaluate_runs(bars: DataFrame, runs: Sequence[Run], interval: str = "1h", balance: float = 10_000.0) -> DataFrame:
    """The metrics (METRICS) of each run that has bars. Indicators and conditions are those of the whole series: they look
    back only, over the begin of a run, too. Runs of one strategy under several names are one strategy in the signals."""
    spark, by_content = bars.sparkSession, {}
    for r in runs:
        by_content.setdefault(json.dumps(asdict(replace(r.strategy, name="")), sort_keys=True, default=str), []).append(r)
    named = [(f"s{i}", own) for i, own in enumerate(by_content.values())]
    strategies = [replace(own[0].strategy, name=name, timeframes=(interval,)) for name, own in named]
    bars = stored(bars)
    parts = [signal_matrix(bars, strategies[i : i + STRATEGIES], interval) for i in range(0, len(strategies), STRATEGIES)]
    signals = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    spans = spark.createDataFrame([(name, r.strategy.name, str(r.start), str(r.end)) for name, own in named for r in own], "strategy string, run_id string, start string, end string")
    spans = spans.select("strategy", "run_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")])
    begin = F.col("ts") - F.expr(f"INTERVAL {duration(interval)}")
    own = signals.join(F.broadcast(spans), "strategy").where((begin >= F.col("start")) & (begin < F.col("end"))).drop("start", "end")  # a row for each run
    done = stored(simulate(own.withColumn("strategy", F.col("run_id")), balance, strategies=[r.strategy for r in runs]))
    sold, c = trades(done), F.col
    cells = sold.groupBy("run_id").agg(
        F.count_if(c("pnl") > 0).alias("winning"), F.sum(F.when(c("pnl") > 0, c("pnl")).otherwise(0.0)).alias("gain"), F.sum(F.when(c("pnl") < 0, -c("pnl")).otherwise(0.0)).alias("loss"),
        F.sum("pnl").alias("pnl"), F.count_if(c("side") == 1).alias("longs"),
    )
    found = M.backtest_metrics(sold, equity(done)).join(cells, "run_id", "left").na.fill(0)
    return found.select(*[c(n.split()[0]).cast(n.split()[1]).alias(n.split()[0]) for n in METRICS.split(", ")])


def scores(found: DataFrame, asks: DataFrame, balance: float = 10_000.0) -> DataFrame:
    """(ask, fitness): each ask (ask, run_id, win, pf, roc, bal, complexity) with the run's metrics weighed by its own weights;
    MISSING for a run without metrics."""
    c = F.col
    weights = (c("win"), c("pf"), c("roc"), c("bal"))
    value = M.fitness(c("total_trades"), c("winning"), c("gain"), c("loss"), c("pnl"), c("longs"), c("complexity"), balance, weights)
    return asks.join(found, "run_id", "left").select("ask", F.when(c("total_trades").isNotNull(), value).otherwise(MISSING).alias("fitness"))


class Log:
    """Metrics of all runs so far, a folder for each batch of them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(f"{METRICS}, batch int").parquet(self.path).drop("batch")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], METRICS)

    def known(self) -> set[str]:
        """Names of the runs: as many as individuals have been evaluated."""
        return {r["run_id"] for r in self.read().select("run_id").collect()}

    def add(self, rows: DataFrame, asked: Sequence[str], number: int) -> None:
        """A run that was asked for and has no metrics is kept as one without trades, so that it isn't asked for again."""
        names = self.spark.createDataFrame([(n,) for n in asked], "run_id string")
        names.join(rows, "run_id", "left").write.mode("overwrite").parquet(f"{self.path}/batch={number}")


def campaign(bars: DataFrame, windows: DataFrame, make: Callable, state: str, combinations: Sequence[Weights] = (USUAL,), params: SearchParams | None = None, pools: Mapping[str, Sequence[str]] | None = None, interval: str = "1h", balance: float = 10_000.0) -> DataFrame:
    """REPORT: the champion of each combination of weights (rank from 1, in their order) on each window (from 0, by
    train_start), with its fitness and Sharpe ratio in training and its metrics in validation, ends exclusive.

    `state` is a folder of the shared store, for this campaign alone. Windows and combinations are configuration. A
    champion without bars or trades has zeros, and a window without any the fitness MISSING.
    """
    spark, log = bars.sparkSession, Log(bars.sparkSession, f"{state}/runs")
    spans = windows.select("train_start", "train_end", "val_start", "val_end").orderBy("train_start").collect()
    searches = {(k, i): evolution(make, params, pools) for k in range(len(combinations)) for i in range(len(spans))}
    people = {key: next(s) for key, s in searches.items()}
    champions: dict[tuple[int, int], Chromosome] = {}
    bars, number, known = stored(bars), 0, log.known()

    def evaluate(wanted: Mapping[str, tuple[Chromosome, object, object]]) -> None:
        nonlocal number, known
        new = {name: w for name, w in wanted.items() if name not in known}
        if new:
            log.add(evaluate_runs(bars, [Run(p.decode(name), a, b) for name, (p, a, b) in new.items()], interval, balance), [*new], number)
            known |= new.keys()
        number += 1

    while people:
        asks, wanted = [], {}
        for (k, i), own in people.items():
            for n, person in enumerate(own):
                name = f"train{i}:{genome(person)}"
                wanted[name] = (person, spans[i]["train_start"], spans[i]["train_end"])
                conditions, indicators, parameters = person.size()
                asks.append((f"{k}:{i}:{n}", name, *map(float, combinations[k]), conditions * 0.8 + indicators * 1.2 + parameters * 0.3))
        evaluate(wanted)
        asked = spark.createDataFrame(asks, "ask string, run_id string, win double, pf double, roc double, bal double, complexity double")
        got = {r["ask"]: r["fitness"] for r in scores(log.read(), asked, balance).collect()}
        after = {}
        for (k, i), own in people.items():
            try:
                after[k, i] = searches[k, i].send([got[f"{k}:{i}:{n}"] for n in range(len(own))])
            except StopIteration as end:
                champions[k, i], history = end.value
                champions[k, i] = (champions[k, i], max(history, default=MISSING))
        people = after
    evaluate({f"val{i}:{genome(p)}": (p, spans[i]["val_start"], spans[i]["val_end"]) for (_, i), (p, _) in champions.items()})
    rows = []
    for (k, i), (p, best) in sorted(champions.items()):
        s = p.decode("champion")
        rows.append((k + 1, i, *[str(x) for x in spans[i]], best, genome(p), json.dumps({"indicators": s.indicators, "entry": s.entry, "exit": s.exit}, sort_keys=True)))
    own = spark.createDataFrame(rows, "rank int, window int, train_start string, train_end string, val_start string, val_end string, fitness double, genome string, champion string")
    found = log.read()
    of = lambda kind: found.select(F.col("run_id").alias(f"{kind}_run"), *[F.coalesce(c, F.lit(0.0)).alias(f"{kind}_{c}") for c in ("sharpe", "win_rate", "total_return")])
    for kind in ("train", "val"):
        own = own.withColumn(f"{kind}_run", F.concat(F.lit(kind), "window", F.lit(":"), "genome")).join(of(kind), f"{kind}_run", "left")
    return own.select(*[F.col(n.split()[0]).cast(n.split()[1]).alias(n.split()[0]) for n in REPORT.split(", ")])


def choose(report: DataFrame) -> DataFrame:
    """One row (rank, efficiency, chosen): the rank of the combination whose windows have the best mean of validation Sharpe
    ratios over their spread, if that is positive, the smaller rank of equals; else rank 1, with efficiency 0. `report`: rank,
    window, train_sharpe, val_sharpe. No rows give rank 1."""
    each = walk_forward_report(report, ["rank"]).where("efficiency > 0")
    best = each.agg(F.max_by(F.struct("rank", "efficiency"), F.struct(F.round("efficiency", 9), -F.col("rank"))).alias("b"))
    return best.select(F.coalesce("b.rank", F.lit(1)).alias("rank"), F.coalesce("b.efficiency", F.lit(0.0)).alias("efficiency"), F.col("b").isNotNull().alias("chosen"))


def calibrated(bars: DataFrame, windows: DataFrame, make: Callable, state: str, best: Sequence[Weights], **how) -> tuple[Weights, float]:
    """Stage 2 of a calibration: (weights, efficiency) of the best of the combinations that stage 1 has ranked, by walk-forward."""
    row = choose(campaign(bars, windows, make, state, best, **how)).first()
    return best[row["rank"] - 1], row["efficiency"]


def save_weights(spark: SparkSession, path: str, weights: Weights, spearman: float, efficiency: float) -> None:
    """Kept as one line of JSON, which replaces the one before."""
    row = spark.createDataFrame([(*map(float, weights), float(spearman), float(efficiency))], WEIGHTS)
    row.coalesce(1).write.mode("overwrite").json(path)


def load_weights(spark: SparkSession, path: str) -> Weights:
    """The kept weights, the usual ones where there are none."""
    try:
        row = spark.read.schema(WEIGHTS).json(path).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        row = None
    return USUAL if row is None else tuple(row)[:4]


WEIGHTS = "win double, pf double, roc double, bal double, spearman double, efficiency double"
