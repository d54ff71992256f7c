"""Component blocks and their weighted combination into one signal per symbol and cycle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from barweave import params
from barweave.functions.carry import carry_last
from barweave.functions.scalar import clamp, fixed, json_safe, lit_or_col, ratio, truthy

C = F.col
BLOCK_TYPE = (
    "struct<score:double,confidence:double,direction:string,reason:string,bias:double,momentum:double>"
)


def block(score: Column, confidence: Column, direction: Column, reason=None, bias=None, momentum=None) -> Column:
    none = F.lit(None)
    return F.struct(
        score.cast("double").alias("score"),
        confidence.cast("double").alias("confidence"),
        direction.alias("direction"),
        (none if reason is None else reason).cast("string").alias("reason"),
        (none if bias is None else bias).cast("double").alias("bias"),
        (none if momentum is None else momentum).cast("double").alias("momentum"),
    )


# --- component builders --------------------------------------------------------------------


def technical_component(has_data=True) -> Column:
    gap = F.when(
        truthy(C("sma_5")) & truthy(C("sma_20")),
        clamp((C("sma_5") - C("sma_20")) / F.nullif(C("sma_20"), F.lit(0.0))),
    ).otherwise(0.0)
    return F.when(
        lit_or_col(has_data),
        block(
            gap,
            F.least(F.lit(1.0), C("signal_confidence")),
            C("overall_signal"),
            F.array_join(F.slice("reasons", 1, 3), "; "),
            momentum=C("rsi"),
        ),
    )


def quant_component(has_data=True) -> Column:
    score = clamp((C("final_score") - 0.5) * 2)
    label = C("recommendation")
    direction = F.when(label.contains("BUY"), "BUY").when(label.contains("SELL"), "SELL").otherwise("HOLD")
    reason = F.concat(F.lit("Quant composite "), fixed(C("final_score"), 2), F.lit(" ("), label, F.lit(")"))
    return F.when(
        lit_or_col(has_data), block(score, F.least(F.lit(1.0), F.abs(score)), direction, reason)
    )


def orderbook_component(has_data=True) -> Column:
    sentiment = C("market_sentiment")
    direction = F.when(sentiment == "BULLISH", "BUY").when(sentiment == "BEARISH", "SELL").otherwise("HOLD")
    sign = F.when(sentiment == "BULLISH", 1).when(sentiment == "BEARISH", -1).otherwise(0)
    return F.when(
        lit_or_col(has_data),
        block(clamp(C("confidence") * sign), C("confidence"), direction, F.array_join("key_factors", ", ")),
    )


def regime_component(has_data=True) -> Column:
    """Never votes SELL; the volatility score of the quant block replaces the regime score."""
    regime = C("market_regime")
    by_regime = F.when(regime == "TRENDING", 0.6).when(regime == "RANGING", 0.2).otherwise(0.0)
    # the composite score has no sub-model details below 50 bars
    score = F.coalesce(F.when(C("n_rows") >= 50, clamp(C("vol_score"), 0.0, 1.0)), by_regime)
    direction = F.when(regime == "TRENDING", "BUY").otherwise("HOLD")
    return F.when(lit_or_col(has_data), block(score, F.least(F.lit(1.0), score), direction))


def trajectory_component() -> Column:
    label, consistency = C("overall_trajectory"), C("trend_consistency")
    bullish, bearish = label.contains("BULLISH"), label.contains("BEARISH")
    size = clamp(consistency, 0.0, 1.0)
    score = F.when(bullish, size).when(bearish, -size).otherwise(0.0)
    direction = F.when(bullish, "BUY").when(bearish, "SELL").otherwise("HOLD")
    return F.when(
        C("trajectory_status") == "ok",
        block(
            score,
            F.least(F.lit(1.0), F.abs(score) + F.abs("acceleration")),
            direction,
            F.concat(label, F.lit(" with consistency "), fixed(consistency, 2)),
        ),
    )


def daily_context() -> Column:
    """Bias of the 20-row mean against the 50-row mean; NULL when either is missing."""
    known = truthy(C("sma_20")) & truthy(C("sma_50"))
    bias = clamp((C("sma_20") - C("sma_50")) / F.nullif(C("sma_50"), F.lit(0.0)))
    return F.when(
        known,
        F.struct(
            F.when(bias >= 0, "BUY").otherwise("SELL").alias("direction"),
            bias.alias("bias"),
            F.least(F.lit(1.0), F.abs(bias) * 2).alias("confidence"),
        ),
    )


def price_block(has_indicators=True) -> Column:
    """Quote fields with the indicator's atr, close, high and low."""

    def from_indicators(name: str) -> Column:
        return F.when(lit_or_col(has_indicators), C(name)).alias(name)

    return F.struct(
        "ltp", "ltq", "best_bid", "best_ask", "spread_pct",
        *[from_indicators(n) for n in ("atr", "close", "high", "low")],
    )


def _field(block: Column, kind: T.DataType, *names: str) -> Column | None:
    """The first of the named fields that is present in a struct; None when it has none of them."""
    found = [block[n] for n in names if isinstance(kind, T.StructType) and n in kind.fieldNames()]
    return F.coalesce(*found) if found else None


def context_bias(block: Column, kind: T.DataType) -> Column:
    """Bias of a context value: the number itself, or a block's bias, else score, else direction times confidence."""
    if isinstance(kind, T.NumericType):
        return clamp(block.cast("double"))
    forms = [clamp(v.cast("double")) for v in (_field(block, kind, "bias"), _field(block, kind, "score")) if v is not None]
    named = _field(block, kind, "direction")
    if named is not None:
        side, given = F.upper(named), _field(block, kind, "confidence")
        confidence = F.lit(1.0) if given is None else clamp(F.coalesce(given, F.lit(1.0)), 0.0, 1.0)
        forms.append(F.when(side.isin("BUY", "BULLISH"), confidence).when(side.isin("SELL", "BEARISH"), -confidence))
    return F.when(block.isNotNull(), F.coalesce(*forms, F.lit(0.0)))


def snapshot_bias(snapshots: DataFrame) -> Column:
    """Daily bias of ``context`` or else ``market``, found there as ``daily_trend`` or else ``1d``."""
    out = []
    for name in ("context", "market"):
        kind = snapshots.schema[name].dataType if name in snapshots.columns else None
        for part in ("daily_trend", "1d"):
            if isinstance(kind, T.StructType) and part in kind.fieldNames():
                out.append(context_bias(C(name)[part], kind[part].dataType))
    return F.coalesce(*out) if out else F.lit(None).cast("double")


def daily_trend_from_technical(technical: Column) -> Column:
    """The technical block's own daily trend, under either name."""
    return F.coalesce(technical["daily_trend"], technical["trend_daily"])


# --- combination ---------------------------------------------------------------------------


def _inferred_direction(b: Column, kind: T.DataType) -> Column:
    """BUY, SELL or HOLD from the first name given, else from the sign of the first lean that is not zero."""
    none = F.lit(None)
    names = [F.nullif(v, F.lit("")) for v in (_field(b, kind, n) for n in ("direction", "signal", "side")) if v is not None]
    leans = [
        F.nullif(b[n].cast("double"), F.lit(0.0))
        for n in ("bias", "trend")
        if n in kind.fieldNames() and isinstance(kind[n].dataType, T.NumericType)
    ]
    named = F.upper(F.coalesce(*names)) if names else none.cast("string")
    lean = F.coalesce(*leans) if leans else none.cast("double")
    return (
        F.when(named.isin("BUY", "SELL", "HOLD"), named)
        .when(lean > 0, "BUY")
        .when(lean < 0, "SELL")
        .otherwise("HOLD")
    )


def contributions(snapshots: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Normalised contributions of the components that are present, as ``components``.

    A component is a struct; it may name its direction ``direction``, ``signal`` or
    ``side``, its lean ``bias`` or ``trend``, its confidence ``confidence`` or
    ``strength`` and its text ``reason`` or ``summary``, and leave fields out.
    Direction, score and confidence are separate steps: nesting them would repeat
    the inner expressions many times in the plan.
    """
    weights = params.WEIGHTS if weights is None else weights
    names = list(weights)
    kinds = {n: snapshots.schema[n].dataType for n in names}
    df = snapshots.withColumns({f"_{n}_direction": _inferred_direction(C(n), kinds[n]) for n in names})

    def given(n: str, kind: str, *fields: str) -> Column:
        found = _field(C(n), kinds[n], *fields)
        return F.lit(None).cast(kind) if found is None else found

    def raw_score(n: str) -> Column:
        direction = C(f"_{n}_direction")
        by_direction = F.when(direction == "BUY", 1.0).when(direction == "SELL", -1.0).otherwise(0.0)
        derived = F.coalesce(given(n, "double", "bias"), by_direction) * F.coalesce(given(n, "double", "momentum"), F.lit(1.0))
        return F.coalesce(given(n, "double", "score"), derived)

    df = df.withColumns(
        {f"_{n}_raw": raw_score(n) for n in names}
        | {f"_{n}_given": F.coalesce(given(n, "double", "confidence", "strength"), F.lit(0.0)) for n in names}
    )
    df = df.withColumns(
        {f"_{n}_bounded": clamp(C(f"_{n}_raw")) for n in names}
        | {f"_{n}_confidence": clamp(C(f"_{n}_given"), 0.0, 1.0) for n in names}
    )

    def part(n: str) -> Column:
        b, direction, bounded = C(n), C(f"_{n}_direction"), C(f"_{n}_bounded")
        title = n.title()
        default = (
            F.when(direction == "HOLD", f"{title} neutral")
            .when(direction == "BUY", f"{title} skewed bullish")
            .otherwise(f"{title} skewed bearish")
        )
        confidence = C(f"_{n}_confidence")
        return F.when(
            b.isNotNull(),
            F.struct(
                F.lit(n).alias("name"),
                F.lit(float(weights[n])).alias("weight"),
                F.when((given(n, "string", "direction") == "SELL") & (bounded > 0), -bounded).otherwise(bounded).alias("score"),
                F.when(confidence > 0, confidence).otherwise(F.abs(bounded)).alias("confidence"),
                direction.alias("direction"),
                F.coalesce(
                    F.nullif(given(n, "string", "reason"), F.lit("")), F.nullif(given(n, "string", "summary"), F.lit("")), default
                ).alias("narrative"),
            ),
        )

    helpers = [f"_{n}_{k}" for n in names for k in ("direction", "raw", "given", "bounded", "confidence")]
    df = df.withColumns({f"_part_{n}": part(n) for n in names}).drop(*helpers)
    return df.withColumn("components", F.array_compact(F.array(*[C(f"_part_{n}") for n in names])))


def combine(df: DataFrame) -> DataFrame:
    """Weighted score and base confidence of the parts left by ``contributions``.

    Plain sums over the few part columns stay in generated code; folding the array
    would not.
    """
    parts = [C(c) for c in df.columns if c.startswith("_part_")]

    def over_parts(f) -> Column:
        return reduce(lambda a, b: a + b, [F.coalesce(f(p), F.lit(0.0)) for p in parts], F.lit(0.0))

    df = df.withColumns(
        {
            "_weight": over_parts(lambda p: p["weight"]),
            "_score": over_parts(lambda p: p["score"] * p["weight"]),
            "_confidence": over_parts(lambda p: p["confidence"] * p["weight"]),
        }
    )
    df = df.withColumns(
        {
            "score": F.coalesce(clamp(ratio(C("_score"), C("_weight"))), F.lit(0.0)),
            "_mean_confidence": F.coalesce(ratio(C("_confidence"), C("_weight")), F.lit(0.0)),
        }
    )
    blended = clamp(C("_mean_confidence") * 0.6 + F.abs("score") * 0.4, 0.0, 1.0)
    helpers = [c for c in df.columns if c.startswith("_part_")]
    return df.withColumn("base_confidence", blended).drop(
        "_mean_confidence", "_weight", "_score", "_confidence", *helpers
    )


def context_adjust(df: DataFrame, bias: str = "daily_bias") -> DataFrame:
    """Confidence scaled by the daily context; no bias leaves it alone."""
    scaled = C("base_confidence") * (1 + 0.15 * C(bias))
    note = F.concat(
        F.lit(f"Daily context ({params.CONTEXT_TIMEFRAME}) bias "),
        F.format_string("%+.2f", C(bias)),
        F.lit(" adjusted confidence"),
    )
    return df.withColumns(
        {
            "confidence": clamp(F.when(truthy(C(bias)), scaled).otherwise(C("base_confidence")), 0.0, 1.0),
            "context_note": F.when(truthy(C(bias)), note),
        }
    )


def raw_direction(score: Column, confidence: Column, hold_threshold: float = params.HOLD_THRESHOLD) -> Column:
    return (
        F.when(confidence < hold_threshold, "HOLD")
        .when(score >= 0.05, "BUY")
        .when(score <= -0.05, "SELL")
        .otherwise("HOLD")
    )


def persistence(
    decisions: DataFrame,
    threshold: float = params.PERSISTENCE_THRESHOLD,
    hold_threshold: float = params.HOLD_THRESHOLD,
    state: DataFrame | None = None,
    segment_rows: int = params.SEGMENT_ROWS,
) -> DataFrame:
    """Gate direction changes by confidence, per symbol in (ts, seq) order.

    Expects ``raw_direction`` and ``confidence``. A direction is committed when it
    is confident enough or repeats the last commitment, so the last commitment
    before a row is the direction of the last confident non-HOLD row before it.
    ``state`` (symbol, committed as +1 / -1) holds commitments of earlier batches.
    """
    code = F.when(C("raw_direction") == "BUY", 1).when(C("raw_direction") == "SELL", -1)
    df = decisions.withColumn("_code", code.cast("int")).withColumn(
        "_commit", F.when(C("confidence") >= threshold, C("_code"))
    )
    df = carry_last(df, "symbol", "ts", "seq", "_commit", "_last", segment_rows=segment_rows)
    if state is not None:
        df = df.join(state.select("symbol", "committed"), "symbol", "left").withColumn(
            "_last", F.coalesce("_last", "committed")
        ).drop("committed")
    return _gated(df, threshold, hold_threshold)


def persist_cycle(
    decisions: DataFrame,
    threshold: float = params.PERSISTENCE_THRESHOLD,
    hold_threshold: float = params.HOLD_THRESHOLD,
    state: DataFrame | None = None,
) -> DataFrame:
    """The same rule for a table with one row per symbol: only ``state`` can precede it."""
    code = F.when(C("raw_direction") == "BUY", 1).when(C("raw_direction") == "SELL", -1)
    if state is None:
        df = decisions.withColumns({"_code": code, "_commit": F.lit(None), "_last": F.lit(None).cast("int")})
    else:
        known = state.select("symbol", C("committed").alias("_last"))
        df = decisions.join(known, "symbol", "left").withColumns({"_code": code, "_commit": F.lit(None)})
    return _gated(df, threshold, hold_threshold)


def _gated(df: DataFrame, threshold: float, hold_threshold: float) -> DataFrame:
    hold = C("_code").isNull()
    gated = ~hold & (C("confidence") < threshold) & (C("_code") != F.coalesce(C("_last"), F.lit(0)))
    return df.withColumns(
        {
            "direction": F.when(hold | gated, "HOLD").otherwise(C("raw_direction")),
            "persistence_reason": F.when(
                gated, "Direction change gated by persistence rule (<0.60 confidence)"
            ).when(
                hold & (C("confidence") < hold_threshold), "Confidence dropped below actionable range"
            ),
        }
    ).drop("_code", "_commit", "_last")


def commitments(decisions: DataFrame, threshold: float = params.PERSISTENCE_THRESHOLD) -> DataFrame:
    """Last commitment of each symbol in a batch, the state to carry forward."""
    from barweave.functions.scalar import order_key

    code = F.when(C("raw_direction") == "BUY", 1).when(C("raw_direction") == "SELL", -1)
    confident = decisions.where((C("confidence") >= threshold) & code.isNotNull())
    return confident.groupBy("symbol").agg(
        F.max_by(code, order_key(C("ts"), C("seq"))).cast("int").alias("committed")
    )


def risk_levels(df: DataFrame) -> DataFrame:
    """Entry, stop and target from the price block and its volatility."""
    p = C("price")
    entry = F.coalesce(F.when(truthy(p["ltp"]), p["ltp"]), p["close"], F.lit(0.0))
    df = df.withColumn("entry_price", entry)
    entry = C("entry_price")
    atr = F.when(truthy(p["atr"]), p["atr"])
    volatility = F.coalesce(atr, F.when(entry > 0, entry * 0.01), F.lit(1.0))
    df = df.withColumn("volatility", volatility)
    usable = (entry > 0) & (C("volatility") > 0)
    buffer = F.greatest(C("volatility") * 1.5, entry * 0.003)
    side = F.when(C("direction") == "BUY", 1).when(C("direction") == "SELL", -1).otherwise(0)
    offset = F.when(usable, buffer * side).otherwise(0.0)
    return df.withColumns({"stop_loss": entry - offset, "target_price": entry + offset * 2})


def position_sizing(
    df: DataFrame, portfolio: float = params.PORTFOLIO_VALUE, risk_pct: float = params.RISK_PCT
) -> DataFrame:
    df = df.withColumn("risk_per_unit", F.abs(C("entry_price") - C("stop_loss")))
    sized = (C("entry_price") > 0) & (C("risk_per_unit") > 0)
    at_risk = portfolio * risk_pct
    return df.withColumns(
        {
            "position_size_value": F.when(sized, at_risk).otherwise(0.0),
            "position_size_qty": F.when(sized, ratio(F.lit(at_risk), C("risk_per_unit"))).otherwise(0.0),
        }
    )


def risk_reward(df: DataFrame) -> DataFrame:
    entry, target, stop = C("entry_price"), C("target_price"), C("stop_loss")
    sign = F.when(C("direction") == "BUY", 1).otherwise(-1)
    usable = (entry > 0) & (target > 0) & (stop > 0) & (entry != stop)
    value = ratio((target - entry) * sign, (entry - stop) * sign)
    return df.withColumn("risk_reward", F.when(usable, F.round(value, 2)).otherwise(0.0))


def titled(name: Column) -> Column:
    """Every run of letters with a capital first, whatever stands between the runs."""
    spaced = F.initcap(F.regexp_replace(name, r"([^\p{L}])", "$1 "))
    return F.regexp_replace(spaced, r"([^\p{L}]) ", "$1")


def rationale(df: DataFrame) -> DataFrame:
    head = F.concat(
        F.lit("Direction "), C("direction"), F.lit(" with "), fixed(C("confidence") * 100, 1),
        F.lit(f"% confidence on {params.EXECUTION_TIMEFRAME} timeframe"),
    )
    lines = F.transform(
        "components",
        lambda c: F.concat(
            titled(c["name"]), F.lit(": "), c["narrative"], F.lit(" ("),
            F.format_string("%+.2f", c["score"]), F.lit(")"),
        ),
    )
    return df.withColumn(
        "rationale", F.concat(F.array(head), lines, F.array_compact(F.array(C("context_note"))))
    )


def decide(
    snapshots: DataFrame,
    weights: dict[str, float] | None = None,
    hold_threshold: float = params.HOLD_THRESHOLD,
    bias: str = "daily_bias",
) -> DataFrame:
    """Components, score, confidence and raw direction, before persistence."""
    if bias not in snapshots.columns:
        snapshots = snapshots.withColumn(bias, snapshot_bias(snapshots))
    df = context_adjust(combine(contributions(snapshots, weights)), bias)
    return df.withColumn("raw_direction", raw_direction(C("score"), C("confidence"), hold_threshold))


def finish(df: DataFrame, portfolio: float = params.PORTFOLIO_VALUE, risk_pct: float = params.RISK_PCT) -> DataFrame:
    """Risk levels, sizing and rationale of decided rows."""
    out = rationale(risk_reward(position_sizing(risk_levels(df), portfolio, risk_pct)))
    return out.select(
        "symbol",
        C("ts").alias("updated_at"),
        "seq",
        "direction",
        "confidence",
        "score",
        "entry_price",
        "target_price",
        "stop_loss",
        "risk_per_unit",
        "position_size_value",
        "position_size_qty",
        "risk_reward",
        "persistence_reason",
        F.lit(params.EXECUTION_TIMEFRAME).alias("timeframe_execution"),
        F.lit(params.CONTEXT_TIMEFRAME).alias("timeframe_context"),
        "rationale",
        "components",
        F.struct(
            F.lit(portfolio).alias("portfolio_value"),
            F.lit(risk_pct).alias("risk_pct"),
            C("price").alias("price_context"),
        ).alias("extra"),
    )


def unified_signal(
    snapshots: DataFrame,
    weights: dict[str, float] | None = None,
    persistence_threshold: float = params.PERSISTENCE_THRESHOLD,
    hold_threshold: float = params.HOLD_THRESHOLD,
    portfolio: float = params.PORTFOLIO_VALUE,
    risk_pct: float = params.RISK_PCT,
    state: DataFrame | None = None,
    segment_rows: int = params.SEGMENT_ROWS,
    single_cycle: bool = False,
) -> DataFrame:
    """One signal per (symbol, cycle) from component snapshots.

    Expects ``symbol, ts, seq``, one struct column per component (NULL when absent),
    ``daily_bias`` and ``price``. With ``single_cycle`` a symbol has one row at most
    and the rule needs no history inside the table.
    """
    decided = decide(snapshots, weights, hold_threshold)
    if single_cycle:
        kept = persist_cycle(decided, persistence_threshold, hold_threshold, state)
    else:
        kept = persistence(decided, persistence_threshold, hold_threshold, state, segment_rows)
    return finish(kept, portfolio, risk_pct)


def signal_payload(signals: DataFrame) -> DataFrame:
    """JSON payload per signal: rounded numbers, non-finite values as null."""
    def safe(name: str) -> Column:
        return json_safe(C(name)).alias(name)

    parts = F.transform(
        "components",
        lambda c: F.struct(
            c["name"].alias("name"),
            c["weight"].alias("weight"),
            F.round(json_safe(c["score"]), 3).alias("score"),
            c["direction"].alias("direction"),
            F.round(json_safe(c["confidence"]), 3).alias("confidence"),
            c["narrative"].alias("narrative"),
        ),
    )
    body = F.struct(
        "symbol",
        "direction",
        F.round(json_safe(C("confidence")), 3).alias("confidence"),
        F.round(json_safe(C("score")), 3).alias("score"),
        *[safe(n) for n in ("entry_price", "target_price", "stop_loss", "risk_per_unit",
                            "position_size_value", "position_size_qty")],
        F.nullif(F.round(json_safe(C("risk_reward")), 2), F.lit(0.0)).alias("risk_reward"),
        F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("updated_at"),
        F.struct(
            C("timeframe_execution").alias("execution"), C("timeframe_context").alias("context")
        ).alias("timeframes"),
        "persistence_reason",
        "rationale",
        parts.alias("components"),
        "extra",
    )
    # explicit nulls: readers rely on the keys being there
    return signals.select(
        "symbol", "updated_at", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload")
    )


# --- snapshots -----------------------------------------------------------------------------


def assemble_snapshot(*sections: DataFrame) -> DataFrame:
    """Merge section tables (symbol, version, section structs) per symbol.

    A newer version overlays an older one field by field and a NULL leaves the old
    value. The tables are stacked and aggregated, so any number of sections costs
    one shuffle; chained full outer joins would need one each.
    """
    flat, fields = [], {}
    for df in sections:
        columns = [C("symbol"), C("version")]
        for f in df.schema.fields:
            if f.name in ("symbol", "version"):
                continue
            for leaf in f.dataType.fields:
                fields.setdefault(f.name, {})[leaf.name] = None
                columns.append(C(f.name)[leaf.name].alias(f"{f.name}.{leaf.name}"))
        flat.append(df.select(*columns))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), flat)
    leaves = [f"{s}.{leaf}" for s, names in fields.items() for leaf in names]
    merged = rows.groupBy("symbol").agg(
        *[
            F.max_by(C(f"`{n}`"), F.when(C(f"`{n}`").isNotNull(), C("version"))).alias(n)
            for n in leaves
        ]
    )
    return merged.select(
        "symbol",
        *[
            F.struct(*[C(f"`{s}.{leaf}`").alias(leaf) for leaf in names]).alias(s)
            for s, names in fields.items()
        ],
    )


def bootstrap_snapshot(bars: DataFrame) -> DataFrame:
    """Quote seeded from the last bar of each symbol with a positive close."""
    last = bars.groupBy("symbol").agg(
        F.max_by("close", "ts").alias("ltp"),
        F.max_by("volume", "ts").alias("ltq"),
        F.max("ts").alias("last_update"),
    )
    return last.where(C("ltp") > 0).select(
        "symbol",
        "ltp",
        F.coalesce("ltq", F.lit(0)).alias("ltq"),
        C("ltp").alias("best_bid"),
        C("ltp").alias("best_ask"),
        "last_update",
    )


def asof_context(
    signals: DataFrame, context: DataFrame, value: str, out: str, segment_rows: int = params.SEGMENT_ROWS
) -> DataFrame:
    """Latest context value at or before each signal: an as-of join.

    Both sides are stacked and the value is carried forward inside segments, so a
    symbol with a long history spreads over many tasks. Context rows sort before
    signals of the same instant.
    """
    left = signals.withColumns({"_side": F.lit(1), "_value": F.lit(None).cast(context.schema[value].dataType)})
    right = context.select("symbol", "ts", C(value).alias("_value")).withColumns(
        {"seq": F.lit(0).cast("bigint"), "_side": F.lit(0)}
    )
    rows = left.unionByName(right, allowMissingColumns=True)
    # context rows come first at equal times: two positions per sequence id
    rows = rows.withColumn(
        "_pos", F.when(C("_side") == 0, F.lit(-1).cast("bigint")).otherwise(C("seq"))
    )
    carried = carry_last(rows, "symbol", "ts", "_pos", "_value", out, segment_rows=segment_rows)
    return carried.where(C("_side") == 1).drop("_side", "_value", "_pos")
