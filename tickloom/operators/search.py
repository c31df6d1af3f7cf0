"""Strategy search: walk-forward windows and reports, calibration, and a genetic search on the driver.

The search itself is small and sequential; what it evaluates is one DataFrame keyed by run, so a generation is one
job however large its population.
"""

from __future__ import annotations

import itertools
import json
import random
from collections.abc import Callable, Generator, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.store import stored
from ..schema import Strategy
from .conditions import ENTRY_POOL, EXIT_POOL, names_in, sanitise
from .indicators import plan_indicators
from .metrics import average_rank, backtest_metrics, fitness_single, pearson
from .signals import signal_matrix
from .simulate import equity, simulate, trades


def walk_forward_windows(ends: DataFrame, train: int, validate: int, step: int) -> DataFrame:
    """(train_start, train_end, val_start, val_end): windows of whole months that fit between start and end."""
    month = lambda n: F.make_ym_interval(F.lit(0), F.lit(n))
    starts = ends.where(F.col("start") + month(train + validate) <= F.col("end"))
    starts = starts.select("end", F.explode(F.sequence(F.col("start"), F.col("end"), month(step))).alias("s"))
    cut, last = F.col("s") + month(train), F.col("s") + month(train + validate)
    return starts.where(last <= F.col("end")).select(F.col("s").alias("train_start"), cut.alias("train_end"), cut.alias("val_start"), last.alias("val_end"))


def walk_forward_report(windows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """From (window, train_sharpe, val_sharpe): mean, spread, range, efficiency, share of gains, correlation, best."""
    v = F.col("val_sharpe")
    spread = F.coalesce(F.stddev_samp(v), F.lit(0.0))
    return windows.groupBy(*by).agg(
        F.count("*").alias("windows"), F.avg(v).alias("mean_val"), spread.alias("std_val"), F.min(v).alias("min_val"), F.max(v).alias("max_val"),
        F.coalesce(F.try_divide(F.avg(v), F.nullif(spread, F.lit(0.0))), F.lit(0.0)).alias("efficiency"),
        (F.count_if(v > 0) * 100.0 / F.count("*")).alias("positive_pct"),
        F.when(F.count("*") >= 3, F.coalesce(pearson(F.col("train_sharpe"), v), F.lit(0.0))).otherwise(0.0).alias("correlation"),
        F.max_by("window", F.struct(v, -F.col("window"))).alias("best_window"),
    )


def spearman(rows: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """(by, rho): the correlation of ranks, ties sharing their mean; 0 where a side is constant."""
    ranked = rows.withColumns({"_x": average_rank(F.col(x), by), "_y": average_rank(F.col(y), by)})
    return ranked.groupBy(*by).agg(F.coalesce(pearson(F.col("_x"), F.col("_y")), F.lit(0.0)).alias("rho"))


def calibrate(scores: DataFrame, grid: DataFrame, components: Mapping[str, str], outcome: str, top: int = 5) -> DataFrame:
    """The weight combinations (rows of `grid`) whose weighted score best ranks the outcome; components: weight column
    to score column. The grid is a parameter, of fixed size."""
    combined = sum((F.col(w) * F.col(s) for w, s in components.items()), F.lit(0.0))
    rows = scores.join(F.broadcast(grid)).select(*grid.columns, outcome, F.round(combined, 9).alias("_score"))
    return spearman(rows, "_score", outcome, grid.columns).orderBy(F.desc(F.round("rho", 9)), *grid.columns).limit(top)


def population_stats(runs: DataFrame, score: Column) -> DataFrame:
    """(mean, diversity) of the scores above -900."""
    good = F.when(score > -900, score)
    mean = F.avg(good)
    return runs.agg(mean.alias("mean"), (F.stddev_pop(good) / (F.abs(mean) + 1e-9)).alias("diversity"))


def parameter_sensitivity(runs: DataFrame, base: str, score: str, by: Sequence[str]) -> DataFrame:
    """(by, sensitivity): the spread of perturbed runs over the base score's size, 1 at most."""
    value = F.stddev_pop(score) / F.greatest(F.abs(F.max(base)), F.lit(1.0))
    return runs.groupBy(*by).agg(F.least(value, F.lit(1.0)).alias("sensitivity"))


def retire(least_sharpe: float = -1.0, least_win_rate: float = 30.0, most_drawdown: float = 30.0) -> Column:
    """Whether a strategy's metrics (`metrics.backtest_metrics`) say that it should go: no trade, or a limit broken."""
    return (F.col("total_trades") == 0) | (F.col("sharpe") < least_sharpe) | (F.col("win_rate") < least_win_rate) | (F.col("max_drawdown") > most_drawdown)


def deployable(sharpe: float = 0.5, win_rate: float = 45.0) -> Column:
    """Whether a new strategy's metrics are good enough to trade with."""
    return (F.col("sharpe") > sharpe) & (F.col("win_rate") > win_rate)


# --- genetic search -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Gene:
    """A number within bounds, at steps from the lower one (0: any number), or a choice."""

    name: str
    value: float | str
    low: float = 0.0
    high: float = 0.0
    choices: tuple[str, ...] = ()
    whole: bool = False
    step: float = 0.0

    def placed(self, x: float) -> Gene:
        """With the value next to x that it may have."""
        x = min(self.high, max(self.low, x))
        if self.step:
            x = min(self.high, self.low + round((x - self.low) / self.step) * self.step)
        return replace(self, value=round(x) if self.whole else round(x, 10))

    def mutate(self, rng: random.Random, scale: float = 0.2) -> Gene:
        """Another choice, the other of two steps, or a number near by, one step away at least."""
        if self.choices:
            return replace(self, value=rng.choice(self.choices))
        if self.step and self.high - self.low <= self.step:
            return self.placed(self.low if float(self.value) > self.low else self.high)
        found = self.placed(float(self.value) + rng.gauss(0, scale * (self.high - self.low)))
        ways = [d for d in (-self.step, self.step) if self.low <= float(self.value) + d <= self.high] or [0.0]
        return found if not self.step or found.value != self.value else self.placed(float(self.value) + rng.choice(ways))


@dataclass(frozen=True)
class Chromosome:
    """Genes of indicators and conditions by slot ("entry.long" ...)."""

    genes: tuple[Gene, ...]
    conditions: tuple[tuple[str, tuple[str, ...]], ...] = ()
    template: Strategy = field(default_factory=lambda: Strategy("candidate"))

    def decode(self, name: str) -> Strategy:
        """The strategy of these genes: indicator.parameter fills an indicator's configuration, indicator.on switches it off at 0,
        model.weight and model.threshold, mode and timeframes are the strategy's own. An indicator is left over even if all
        are off. Conditions that need one that is off go; a side that loses all gets one on a default average."""
        indicators: dict[str, dict] = {}
        off, own = set(), {}
        for g in self.genes:
            kind, dot, parameter = g.name.partition(".")
            if kind == "model" or not dot:
                own[g.name] = g.value
            elif parameter == "on":
                indicators.setdefault(kind, {})
                off |= {kind} if not g.value else set()
            else:
                indicators.setdefault(kind, {})[parameter] = g.value
        spare = next((k for k in KEPT if k in indicators), next(iter(indicators), None))
        on = {k: c for k, c in indicators.items() if k not in off} or ({spare: indicators[spare]} if spare else {})
        known = {"close", "volume", "open", "high", "low", *plan_indicators(on).columns()} if off else set()
        slots: dict[str, dict] = {"entry": {}, "exit": {}}
        for slot, texts in self.conditions:
            kind, _, where = slot.partition(".")
            default = "close > ema_fast" if where == "long" else "close < ema_fast"
            slots[kind][where] = tuple(sanitise(texts, known, default)) if texts and off else texts
        weight = own.get("model.weight")
        given = {"mode": own.get("mode"), "timeframes": tuple(str(own["timeframes"]).split(",")) if "timeframes" in own else None, "ml_weight": weight, "ml_threshold": own.get("model.threshold")}
        made = replace(self.template, name=name, indicators=on, entry=slots["entry"], exit=slots["exit"])
        return replace(made, **{k: v for k, v in given.items() if v is not None})

    def size(self) -> tuple[int, int, int]:
        """(conditions, indicators that are on, numbers)."""
        off = {g.name.partition(".")[0] for g in self.genes if g.name.endswith(".on") and not g.value}
        kinds = {g.name.partition(".")[0] for g in self.genes if "." in g.name} - {"model"} - off
        return sum(len(t) for _, t in self.conditions), len(kinds), sum(1 for g in self.genes if not g.choices and not g.name.endswith(".on"))


# The numbers that a search varies: lowest, highest, step; and the choices.
GENES = {
    "rsi.period": (5, 28, 1), "macd.fast": (6, 20, 2), "macd.slow": (18, 40, 2), "macd.signal": (5, 15, 1),
    "bollinger.period": (10, 40, 2), "bollinger.stddev": (1.0, 3.5, 0.25), "adx.period": (7, 28, 1), "ema.period": (5, 50, 2),
    "atr.period": (7, 28, 1), "stoch.k_period": (5, 21, 1), "stoch.d_period": (3, 9, 1), "cci.period": (7, 28, 1),
    "sma.period": (10, 100, 2),
}
MODEL = {"model.weight": (0.0, 0.5, 0.05), "model.threshold": (0.5, 0.85, 0.05)}
MODES = ("trend", "range", "scalp", "momentum")
TIMEFRAMES = ("1m", "5m", "15m", "1h", "4h")
# The chance of an indicator at the start.
CHANCES = {"rsi": 0.6, "macd": 0.6, "bollinger": 0.5, "adx": 0.4, "ema": 0.4, "atr": 0.3, "stoch": 0.4, "cci": 0.3, "obv": 0.3, "sma": 0.3}
#: Values of parameters that a strategy leaves out.
USUAL = {"rsi.period": 14, "macd.fast": 12, "macd.slow": 26, "macd.signal": 9, "bollinger.period": 20, "bollinger.stddev": 2.0, "adx.period": 14, "ema.period": 9, "atr.period": 14, "stoch.k_period": 14, "stoch.d_period": 3, "cci.period": 14, "sma.period": 50}
#: Indicators without a parameter, and those of which the first that there is stays on.
BARE, KEPT = ("obv",), ("rsi", "macd", "ema")
POOLS = {f"{kind}.{side}": pool[side] for kind, pool in (("entry", ENTRY_POOL), ("exit", EXIT_POOL)) for side in ("long", "short")}


def gene(name: str, value: float) -> Gene:
    """A number of GENES or MODEL with its bounds and step."""
    low, high, step = (GENES | MODEL)[name]
    return Gene(name, value, low, high, whole=isinstance(step, int), step=step)


def _own_genes(weight: float, threshold: float, mode: str, timeframes: Sequence[str]) -> tuple[Gene, ...]:
    pairs = tuple(",".join(p) for p in itertools.combinations(TIMEFRAMES, 2))
    return gene("model.weight", weight), gene("model.threshold", threshold), Gene("mode", mode, choices=MODES), Gene("timeframes", ",".join(timeframes), choices=pairs)


def encode(strategy: Strategy) -> Chromosome:
    """The genes of a strategy: `decode` gives back its indicators' varied parameters and its conditions, its mode, its timeframes and
    its model's weight (0 if it has none) and threshold (0.6)."""
    genes = [gene(name, strategy.indicators[name.partition(".")[0]].get(name.partition(".")[2], USUAL[name])) for name in GENES if name.partition(".")[0] in strategy.indicators]
    on = [Gene(f"{k}.on", 1, 0, 1, whole=True, step=1) for k in (*dict.fromkeys(n.partition(".")[0] for n in GENES), *BARE) if k in strategy.indicators]
    slots = tuple((f"{kind}.{side}", tuple(own.get(side, ()))) for kind, own in (("entry", strategy.entry), ("exit", strategy.exit)) for side in ("long", "short"))
    own = _own_genes(strategy.ml_weight or 0.0, 0.6 if strategy.ml_threshold is None else strategy.ml_threshold, strategy.mode, strategy.timeframes)
    return Chromosome((*genes, *on, *own), slots, strategy)


def random_chromosome(rng: random.Random, template: Strategy | None = None, share: float | None = None, conditions: tuple[int, int] = (1, 3)) -> Chromosome:
    """Indicators with the published chances (or `share` each; one at least), parameters at steps within their bounds, a model
    with a chance of 0.3, one or two timeframes, and conditions of the published predicates whose columns are there; a side
    without any gets one on the close and a default average."""
    on = [k for k, chance in CHANCES.items() if rng.random() < (chance if share is None else share)] or [rng.choice([*CHANCES])]
    genes = tuple(gene(n, low).placed(rng.uniform(low, high)) for n, (low, high, _) in GENES.items() if n.partition(".")[0] in on)
    genes += tuple(Gene(f"{k}.on", 1, 0, 1, whole=True, step=1) for k in on)
    frames = sorted(rng.sample(TIMEFRAMES, rng.choice((1, 2))), key=TIMEFRAMES.index)
    genes += _own_genes(rng.choice((0.1, 0.2, 0.3)) if rng.random() < 0.3 else 0.0, gene("model.threshold", 0.5).placed(rng.uniform(0.55, 0.75)).value, rng.choice(MODES), frames)
    found = Chromosome(genes, (), template or Strategy("candidate"))
    known = {"close", "volume", *plan_indicators(found.decode("x").indicators).columns()}
    slots = []
    for slot, pool in POOLS.items():
        usable = [t for t in pool if names_in(t) <= known]
        n = min(len(usable), rng.randint(*conditions))
        slots.append((slot, tuple(rng.sample(usable, n)) or (("close > ema_fast" if slot.endswith("long") else "close < ema_fast"),)))
    return replace(found, conditions=tuple(slots))


def evaluate(bars: DataFrame, strategies: Sequence[Strategy], interval: str = "1h", balance: float = 10_000.0, complexity: Mapping[str, float] | None = None) -> DataFrame:
    """(run_id, fitness and all metrics) of each strategy as a run of its own: signals, simulation and metrics of a whole
    population in one job. A strategy that has no bar has no row."""
    own = [(s.name, float((complexity or {}).get(s.name, 0.0))) for s in strategies]
    signals = signal_matrix(bars, strategies, interval).withColumn("run_id", F.col("strategy"))
    done = stored(simulate(signals, balance, strategies=strategies))
    found = backtest_metrics(trades(done), equity(done))
    weights = bars.sparkSession.createDataFrame(own, "run_id string, complexity double")  # one row for each strategy
    c = F.col
    score = fitness_single(c("sharpe"), c("win_rate"), c("profit_factor"), c("max_drawdown"), c("total_trades"), c("total_return"), c("complexity"))
    return found.join(F.broadcast(weights), "run_id").withColumn("fitness", score)


def scorer(bars: DataFrame, interval: str = "1h", missing: float = -1000.0) -> Callable[[list[Chromosome]], list[float]]:
    """For `evolve`: the fitness of a population on these bars; the driver gets one number for each individual."""

    def score(people: list[Chromosome]) -> list[float]:
        strategies, weight = [], {}
        for i, person in enumerate(people):
            conditions, indicators, parameters = person.size()
            strategies.append(replace(person.decode(f"c{i}"), timeframes=(interval,)))
            weight[f"c{i}"] = conditions * 0.8 + indicators * 1.2 + parameters * 0.3
        got = {r["run_id"]: r["fitness"] for r in evaluate(bars, strategies, interval, complexity=weight).select("run_id", "fitness").collect()}
        return [got.get(f"c{i}", missing) for i in range(len(people))]

    return score


def walk_forward(bars: DataFrame, windows: DataFrame, make: Callable[[random.Random], Chromosome], state: str, params: SearchParams | None = None, pools: Mapping[str, Sequence[str]] | None = None, interval: str = "1h") -> DataFrame:
    """(window, train_start, train_end, val_start, val_end, train_sharpe, val_sharpe, val_win_rate, val_total_return, champion)
    of each window: a search on its training bars, and the champion's metrics on its validation bars, ends exclusive.

    Finished windows are rows of `state`, a folder of the shared store; a run that was broken off goes on with the others.
    Windows are a few rows of configuration. A champion without trades has zeros.
    """
    spark = bars.sparkSession
    schema = "window int, train_start timestamp_ntz, train_end timestamp_ntz, val_start timestamp_ntz, val_end timestamp_ntz, train_sharpe double, val_sharpe double, val_win_rate double, val_total_return double, champion string"
    try:
        done = {r["window"] for r in spark.read.schema(schema).parquet(state).select("window").collect()}
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        done = set()
    between = lambda a, b: bars.where((F.col("bar_start") >= F.lit(a)) & (F.col("bar_start") < F.lit(b)))
    for i, w in enumerate(windows.orderBy("train_start").collect()):
        if i in done:
            continue
        train, check = stored(between(w["train_start"], w["train_end"])), between(w["val_start"], w["val_end"])
        champion, _ = evolve(make, scorer(train, interval), params, pools)
        strategy = replace(champion.decode("champion"), timeframes=(interval,))
        seen = [evaluate(rows, [strategy], interval).select("sharpe", "win_rate", "total_return").first() for rows in (train, check)]
        values = [[0.0, 0.0, 0.0] if r is None else [*r] for r in seen]
        named = json.dumps({"indicators": strategy.indicators, "entry": strategy.entry, "exit": strategy.exit}, sort_keys=True)
        row = (i, w["train_start"], w["train_end"], w["val_start"], w["val_end"], values[0][0], *values[1], named)
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(state)
    return spark.read.schema(schema).parquet(state)


@dataclass(frozen=True)
class SearchParams:
    population: int = 80
    generations: int = 30
    elites: int = 8
    immigrants: int = 8
    tournament: int = 3
    mutation: float = 0.25
    crossover: float = 0.7
    patience: int = 10
    seed: int = 0


def cross(a: Chromosome, b: Chromosome, rng: random.Random, pools: Mapping[str, Sequence[str]]) -> Chromosome:
    """Each gene, by its name, from either parent; an indicator that one of them lacks comes along whole, or not at all.
    Conditions of a slot from the union of both, as many as one of them has."""
    one, two = ({g.name: g for g in p.genes} for p in (a, b))
    kind = lambda name: name.partition(".")[0]
    common = {kind(n) for n in one} & {kind(n) for n in two}
    taken = {k: rng.random() < 0.5 for k in dict.fromkeys(map(kind, (*one, *two))) if k not in common}
    genes = []
    for name in dict.fromkeys((*one, *two)):
        if kind(name) in common:
            genes.append(rng.choice([g for g in (one.get(name), two.get(name)) if g]))
        elif taken[kind(name)]:
            genes.append(one.get(name) or two[name])
    genes = genes or [*a.genes]
    other, slots = dict(b.conditions), []
    for slot, texts in a.conditions:
        both = [*dict.fromkeys([*texts, *other.get(slot, ())])]
        n = max(1, len(rng.choice([texts, other.get(slot, texts)])))
        slots.append((slot, tuple(rng.sample(both, min(n, len(both))))))
    return replace(a, genes=tuple(genes), conditions=tuple(slots))


def mutate(c: Chromosome, rng: random.Random, rate: float, pools: Mapping[str, Sequence[str]]) -> Chromosome:
    genes = tuple(g.mutate(rng) if rng.random() < rate else g for g in c.genes)
    slots = []
    for slot, texts in c.conditions:
        if pools.get(slot) and rng.random() < rate:
            if rng.random() < 0.5 and len(texts) > 1:  # one condition less, or one more
                gone = rng.randrange(len(texts))
                texts = (*texts[:gone], *texts[gone + 1 :])
            else:
                texts = tuple(dict.fromkeys((*texts, rng.choice(pools[slot]))))
        slots.append((slot, texts))
    return replace(c, genes=genes, conditions=tuple(slots))


def evolution(make: Callable[[random.Random], Chromosome], params: SearchParams | None = None, pools: Mapping[str, Sequence[str]] | None = None) -> Generator[list[Chromosome], list[float], tuple[Chromosome, list[float]]]:
    """A search step by step: it yields a population, is sent its scores, and returns (champion, best score of each generation).
    What it yields depends on the seed and on the scores alone."""
    p, pools = params or SearchParams(), pools or {}
    rng = random.Random(p.seed)
    people = [make(rng) for _ in range(p.population)]
    champion, best, history, idle = people[0], float("-inf"), [], 0
    for _ in range(p.generations):
        scored = sorted(zip((yield people), range(len(people)), strict=True), key=lambda x: (-x[0], x[1]))
        ranked = [people[i] for _, i in scored]
        history.append(scored[0][0])
        if scored[0][0] > best:
            best, champion, idle = scored[0][0], ranked[0], 0
        else:
            idle += 1
            if idle >= p.patience:
                break
        score = [s for s, _ in scored]

        def pick(score: list[float] = score, ranked: list[Chromosome] = ranked) -> Chromosome:
            return ranked[max(rng.sample(range(len(ranked)), min(p.tournament, len(ranked))), key=score.__getitem__)]

        people = ranked[: p.elites] + [make(rng) for _ in range(p.immigrants)]
        while len(people) < p.population:
            child = cross(pick(), pick(), rng, pools) if rng.random() < p.crossover else pick()
            people.append(mutate(child, rng, p.mutation, pools))
    return champion, history


def evolve(make: Callable[[random.Random], Chromosome], evaluate: Callable[[list[Chromosome]], list[float]], params: SearchParams | None = None, pools: Mapping[str, Sequence[str]] | None = None) -> tuple[Chromosome, list[float]]:
    """(champion, best score of each generation). `evaluate` scores a whole population in one call."""
    search = evolution(make, params, pools)
    people = next(search)
    while True:
        try:
            people = search.send(evaluate(people))
        except StopIteration as end:
            return end.value
