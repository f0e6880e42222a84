"""Price quotes: parsing, validation, coverage, best offers, mirrored pairs, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.odds import allows_push, residual_threshold
from tidemark.functions.times import minutes_between
from tidemark.operators.blocks import prior_nodes, prior_sums
from tidemark.operators.scan import beside, quantiles, running, stored

MARKETS = ("moneyline", "spread", "total")


def offer_rank(book_order: list[str], market: str = "market", side: str = "side", line: str = "line", price: str = "price", book: str = "book") -> list[Column]:
    """ST-04. The order of preference: best number for the side, then price, then the fixed order of books, then the book's name."""
    number = F.when(F.col(market) == "moneyline", F.lit(0.0)).when(F.col(side) == "over", -F.col(line)).otherwise(F.col(line))
    place = F.array_position(F.array(*map(F.lit, book_order)), F.col(book)) if book_order else F.lit(0)
    return [number.desc_nulls_last(), F.col(price).desc_nulls_last(), F.when(place > 0, place).otherwise(len(book_order) + 1).asc(), F.col(book).asc()]


def best_offers(quotes: DataFrame, key: list[str], book_order: list[str], **columns: str) -> DataFrame:
    """ST-04. The best quote of each key (game, market, side); ties end with the book's name."""
    w = Window.partitionBy(*key).orderBy(*offer_rank(book_order, **columns))
    return quotes.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def max_price_offers(quotes: DataFrame, key: list[str], price: str, carry: list[str]) -> DataFrame:
    """ST-05. One offer a key (game, book, side): the highest price, with the columns that go with it; ties by those columns."""
    best = F.max(F.struct(F.col(price), *(F.col(c) for c in carry))).alias("_b")
    return quotes.groupBy(*key).agg(best).select(*key, f"_b.{price}", *(f"_b.{c}" for c in carry))


def quoted_by_all(quotes: DataFrame, key: list[str], book: str, books: list[str]) -> DataFrame:
    """ST-05, AG-11. Keys that every one of the books quotes (relational division)."""
    held = quotes.where(F.col(book).isin(books)).groupBy(*key).agg(F.count_distinct(book).alias("_n"))
    return held.where(F.col("_n") == len(set(books))).select(*key)


def mirrored_quotes(quotes: DataFrame, key: list[str], sides: tuple[str, str], opposite: bool, line: str = "line", price: str = "price", digits: int = 6) -> DataFrame:
    """JN-14. Keys whose two sides meet at exactly one line, with that line (of the first side) and both best prices.

    opposite: the second side's line is minus the first's (spreads); else equal (totals). Lines match when rounded.
    """
    at = F.round(F.when((F.col("side") == sides[1]) & F.lit(opposite), -F.col(line)).otherwise(F.col(line)), digits) + F.lit(0.0)
    both = quotes.where(F.col("side").isin(*sides)).groupBy(*key, at.alias("line")).agg(*(F.max(F.when(F.col("side") == s, F.col(price))).alias(f"price_{s}") for s in sides))
    both = both.where(F.col(f"price_{sides[0]}").isNotNull() & F.col(f"price_{sides[1]}").isNotNull())
    return both.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.first("line").alias("line"), *(F.first(f"price_{s}").alias(f"price_{s}") for s in sides)).where("_n = 1").drop("_n")


def exact_offers(rows: DataFrame, offers: DataFrame, key: list[str], line: str = "line", digits: int = 6, how: str = "left") -> DataFrame:
    """JN-15. Joined on the key and the rounded line, null lines equal (prices without a line)."""
    at = lambda df: F.coalesce(F.round(df[line], digits), F.lit(-1e9))
    right = offers.withColumn("_line", at(offers)).drop(line)
    return rows.withColumn("_line", at(rows)).join(right, [*key, "_line"], how).drop("_line")


def parsed_market(market: Column | str, outcomes: Column | str) -> Column:
    """FN-31. Whether a pair of quotes is whole: two outcomes with different names, prices, a spread's points symmetric, a total's equal."""
    o = F.col(outcomes) if isinstance(outcomes, str) else outcomes
    m = F.col(market) if isinstance(market, str) else market
    a, b = F.try_element_at(o, F.lit(1)), F.try_element_at(o, F.lit(2))
    near = lambda x: F.abs(x) <= 1e-9
    pair = (F.size(o) == 2) & (a["name"] != b["name"]) & a["price"].isNotNull() & b["price"].isNotNull()
    shape = F.when(m == "h2h", F.lit(True)).when(m == "spreads", near(a["point"] + b["point"])).when(m == "totals", near(a["point"] - b["point"])).otherwise(F.lit(False))
    return F.coalesce(pair & shape, F.lit(False))


def coverage(quotes: DataFrame, book: str, market: str, game: str, markets: list[str], total: int | None = None) -> DataFrame:
    """AG-10. For each book the games it quotes by market and in all markets, and the shares of `total` games if given."""
    per = quotes.groupBy(book, game).agg(*(F.bool_or(F.col(market) == m).alias(m) for m in markets))
    whole = F.lit(True)
    for m in markets:
        whole = whole & F.col(m)
    out = per.groupBy(book).agg(*(F.count_if(F.col(m)).alias(f"n_{m}") for m in markets), F.count_if(whole).alias("n_complete"))
    return out.withColumns({f"share_{m}": F.col(f"n_{m}") / F.lit(float(total)) for m in [*markets, "complete"]}) if total else out


def per_season(games: DataFrame, season: str, conditions: dict[str, Column]) -> DataFrame:
    """AG-02. Rows and rows that meet each condition."""
    return games.groupBy(season).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(name) for name, c in conditions.items()))


def distinct_histogram(df: DataFrame, group: list[str], what: str, name: str = "n_distinct") -> DataFrame:
    """AG-12. How many groups have how many different values."""
    return df.groupBy(*group).agg(F.count_distinct(what).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n_groups"))


def game_presence(quotes: DataFrame, game: str, book: str, market: str, markets: list[str]) -> DataFrame:
    """AG-13. For each game which markets are quoted, its books, and the books that quote all markets."""
    per = quotes.groupBy(game, book).agg(F.collect_set(market).alias("_m"))
    want = F.array(*map(F.lit, markets))
    complete = F.size(F.array_except(want, "_m")) == 0
    out = per.groupBy(game).agg(*(F.bool_or(F.array_contains("_m", m)).alias(f"has_{m}") for m in markets), F.count(F.lit(1)).alias("n_books"), F.array_sort(F.collect_set(F.when(complete, F.col(book)))).alias("complete_books"))
    return out.withColumn("n_complete_books", F.size("complete_books"))


def quality_flags(quotes: DataFrame, game: str, book: str, market: str, valid: Column, markets: list[str]) -> DataFrame:
    """AG-14. For each game a sorted array of MISSING_<market>, MALFORMED and DUPLICATE."""
    per = quotes.groupBy(game, book, market).agg(F.count(F.lit(1)).alias("_n"), F.count_if(~valid).alias("_bad"))
    out = per.groupBy(game).agg(*(F.bool_or((F.col(market) == m) & (F.col("_n") > F.col("_bad"))).alias(f"_has_{m}") for m in markets), F.sum("_bad").alias("_bad"), F.max("_n").alias("_most"))
    flags = [F.when(~F.col(f"_has_{m}"), f"MISSING_{m}") for m in markets] + [F.when(F.col("_bad") > 0, "MALFORMED"), F.when(F.col("_most") > 1, "DUPLICATE")]
    return out.select(game, F.array_sort(F.array_compact(F.array(*flags))).alias("flags"))


def summary(profit: str = "profit", price: str = "price_decimal", block: str | None = None) -> list[Column]:
    """AG-15. Aggregates of a graded ledger: n, wins, losses, pushes, hit rate, mean price, break-even, profit, ROI, blocks."""
    p = F.col(profit)
    wins, losses = F.count_if(p > 0), F.count_if(p < 0)
    return [
        F.count(p).alias("n"),
        wins.alias("wins"),
        losses.alias("losses"),
        F.count_if(p == 0).alias("pushes"),
        (wins / F.nullif(wins + losses, F.lit(0))).alias("hit_rate"),
        F.avg(price).alias("mean_price"),
        F.avg(1 / F.col(price)).alias("break_even"),
        F.sum(p).alias("profit"),
        (F.sum(p) / F.nullif(F.count(p), F.lit(0))).alias("roi"),
        *([F.count_distinct(block).alias("n_blocks")] if block else []),
    ]


def summaries(ledger: DataFrame, grains: list[list[str]], aggregates: list[Column]) -> DataFrame:
    """AG-16, AG-37, AG-40. The aggregates at several grains in one pass; columns outside a grain are null, and grain names it."""
    dims = list(dict.fromkeys(c for g in grains for c in g))
    grouped = ledger.groupingSets([[F.col(c) for c in g] for g in grains], *dims).agg(*aggregates, F.grouping_id().alias("_g"))
    label = F.lit(None).cast("string")
    for g in grains:
        bits = sum(1 << (len(dims) - 1 - k) for k, c in enumerate(dims) if c not in g)
        label = F.when(F.col("_g") == bits, "+".join(g) or "ALL").otherwise(label)
    return grouped.withColumn("grain", label).drop("_g")


def count_matrix(df: DataFrame, dims: list[str], season: str, seasons: list[int]) -> DataFrame:
    """AG-23. Counts by dimension and season, and their total."""
    wide = df.groupBy(*dims).agg(*(F.count_if(F.col(season) == s).alias(f"s{s}") for s in seasons), F.count(F.lit(1)).alias("total"))
    return wide.withColumn("other", F.col("total") - sum((F.col(f"s{s}") for s in seasons), F.lit(0)))


def corroborated(rows: DataFrame, key: list[str], model: str, side: str, value: str, voters: tuple[str, str], source: str) -> DataFrame:
    """JN-22. Keys on whose side two models agree, with the third model's value; keys without all three drop out."""
    of = lambda m, c: F.max(F.when(F.col(model) == m, F.col(c)))
    wide = rows.groupBy(*key).agg(of(voters[0], side).alias("side"), of(voters[1], side).alias("_s2"), of(source, value).alias(value))
    return wide.where(F.col("side").eqNullSafe(F.col("_s2")) & F.col("side").isNotNull() & F.col(value).isNotNull()).drop("_s2")


def concentration(rows: DataFrame, group: str, value: str, top: int = 3) -> DataFrame:
    """AG-19. One row: the group with the largest absolute sum, the one with most rows, and the worst groups' share of all losses."""
    per = rows.groupBy(group).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    worst = per.where("s < 0").orderBy("s", group).limit(top).agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("worst"))
    all_ = per.agg(F.max_by(group, F.struct(F.abs("s"), F.col(group))).alias("largest"), F.max_by("s", F.struct(F.abs("s"), F.col(group))).alias("largest_value"), F.max_by(group, F.struct("n", F.col(group))).alias("most_rows"), F.sum(F.least("s", F.lit(0.0))).alias("losses"))
    return all_.crossJoin(worst).select("largest", "largest_value", "most_rows", (F.col("worst") / F.nullif("losses", F.lit(0.0))).alias("top_loss_share"))  # one row each


def set_overlap(rows: DataFrame, key: list[str], member: str, a: str, b: str) -> DataFrame:
    """AG-20, SO-05. Sizes of two sets of keys, what they share, what each has alone, and their Jaccard index."""
    per = rows.groupBy(*key).agg(F.bool_or(F.col(member) == a).alias("a"), F.bool_or(F.col(member) == b).alias("b"))
    both, one, two = F.count_if(F.col("a") & F.col("b")), F.count_if(F.col("a")), F.count_if(F.col("b"))
    return per.agg(one.alias("n_a"), two.alias("n_b"), both.alias("n_both"), (one - both).alias("only_a"), (two - both).alias("only_b"), (both / F.nullif(one + two - both, F.lit(0))).alias("jaccard"))


def running_profit(ledger: DataFrame, group: list[str], order: list[str], profit: str = "profit", sliced: bool = False) -> DataFrame:
    """WN-11. The number of bets, wins, profit and ROI so far in each group; sliced: a group's rows are cut into ranges over many tasks."""
    if sliced:
        p = F.col(profit)
        out = running(ledger, group, order, {"bet_no": F.when(p.isNotNull(), 1).otherwise(0), "cum_wins": F.when(p > 0, 1).otherwise(0), "cum_profit": p})
        return out.withColumn("cum_roi", F.col("cum_profit") / F.col("bet_no"))
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.count(profit).over(w)
    return ledger.withColumns({"bet_no": n, "cum_wins": F.count_if(F.col(profit) > 0).over(w), "cum_profit": F.sum(profit).over(w), "cum_roi": F.sum(profit).over(w) / n})


def residual_probabilities(offers: DataFrame, residuals: DataFrame, block: str = "block_ord", residual: str = "residual") -> DataFrame:
    """AG-35. offers (market, side, line, predicted, block) with p_win, p_push, p_loss of their threshold among residuals of earlier blocks, Jeffreys smoothed.

    An offer without an earlier residual has nulls. Residuals are counted by block and value, and added up over earlier
    blocks by nodes of the calendar; offers and residuals never meet as pairs (see lattice_probabilities).
    """
    calendar = offers.select(F.col(block).alias("block_ord")).union(residuals.select(F.col(block).alias("block_ord"))).distinct()
    per = residuals.where(F.col(residual).isNotNull()).groupBy(F.col(block).alias("block_ord"), F.col(residual).cast("double").alias("r")).agg(F.count(F.lit(1)).alias("n"))
    known = prior_sums(per, prior_nodes(calendar), ["r"], ["n"]).withColumnRenamed("target", block)
    return lattice_probabilities(offers, known, [block])


def lattice_probabilities(offers: DataFrame, residuals: DataFrame, by: list[str], predicted: str = "predicted", total: str | None = None) -> DataFrame:
    """AG-35. offers (by, market, side, line, predicted) with p_win, p_push and p_loss among their group's residuals (by, r, n).

    A residual is what a result differs from its prediction. On a line that a result can equal, those within half a point
    below to under half a point above the threshold push; wins, pushes and losses each count half a one more. A group
    without residuals, and an offer without a threshold, have nulls. Thresholds and residuals are put in one order and
    counted by a scan over ranges of it, so both may be any number. total: a column of offers that has the number of their
    group's residuals, null without any; if it isn't given, residuals are made and counted once more.
    """
    side = F.col("side").isin("home", "over")
    push, t = allows_push("line"), residual_threshold("market", "side", predicted, "line")
    target = stored(offers.withColumns({"_push": push, "_t": t, "_row": F.monotonically_increasing_id()}), "thresholds")
    # of each offer the places to count up to: kind 0 counts what is less, kind 2 also what is equal
    low = F.when(F.col("_push"), F.struct((F.col("_t") - 0.5).alias("x"), F.lit(0).alias("kind"))).otherwise(F.struct(F.col("_t").alias("x"), F.when(side, 2).otherwise(0).alias("kind")))
    high = F.when(F.col("_push"), F.struct((F.col("_t") + 0.5).alias("x"), F.lit(0).alias("kind")))
    asked = target.where("_t is not null").select(*by, "_row", F.posexplode(F.array_compact(F.array(low, high))).alias("end", "at")).select(*by, "_row", "end", "at.x", "at.kind", F.lit(0).cast("long").alias("n"))
    given = residuals.select(*by, F.lit(None).cast("long").alias("_row"), F.lit(None).cast("int").alias("end"), F.col("r").alias("x"), F.lit(1).alias("kind"), F.col("n").cast("long").alias("n"))
    counted = running(asked.unionByName(given), by, ["x", "kind"], {"upto": "n"}).where("_row is not null")
    ends = counted.groupBy("_row").agg(F.max(F.when(F.col("end") == 0, F.col("upto"))).alias("_low"), F.max(F.when(F.col("end") == 1, F.col("upto"))).alias("_high"))
    out = target.join(ends, "_row", "left")
    out = out.withColumn("_all", F.col(total).cast("long")) if total else out.join(residuals.groupBy(*by).agg(F.sum("n").cast("long").alias("_all")), by, "left")
    below, upto = F.coalesce("_low", F.lit(0)), F.coalesce("_high", "_low", F.lit(0))
    pushed = F.when(F.col("_push"), upto - below).otherwise(0)
    win = F.when(side, F.col("_all") - upto).otherwise(below)
    loss = F.col("_all") - pushed - win
    den = F.when(F.col("_t").isNotNull(), F.col("_all")) + F.when(F.col("_push"), 1.5).otherwise(1.0)
    return out.select(*offers.columns, ((win + 0.5) / den).alias("p_win"), F.when(den.isNotNull(), F.when(F.col("_push"), (pushed + 0.5) / den).otherwise(0.0)).alias("p_push"), ((loss + 0.5) / den).alias("p_loss"))


def market_summary(board: DataFrame, market: str = "market", tier: str = "tier", status: str = "status", reason: str = "reason") -> DataFrame:
    """AG-36. For each market: rows, supported rows, and histograms of tier, status and reason as maps."""

    def histogram(column: str) -> DataFrame:
        per = board.where(F.col(column).isNotNull()).groupBy(market, column).agg(F.count(F.lit(1)).alias("_n"))
        return per.groupBy(market).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(column), F.col("_n"))))).alias(f"by_{column}"))

    out = board.groupBy(market).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(tier) != "UNSUPPORTED").alias("n_supported"))
    for c in (tier, status, reason):
        out = out.join(histogram(c), market, "left")
    return out


def contribution_split(board: DataFrame, coefficients: DataFrame, key: list[str], coefficient: str = "coefficient", value: str = "value", profit: str = "profit") -> DataFrame:
    """AG-39. Profit by the signs of a block's fitted coefficient and of the offer's value."""
    sign = lambda c: F.when(F.col(c) > 0, "positive").when(F.col(c) < 0, "negative").otherwise("zero")
    joined = board.join(coefficients, key, "left").withColumns({"coefficient_sign": sign(coefficient), "value_sign": sign(value)})
    return joined.groupBy("coefficient_sign", "value_sign").agg(F.count(F.lit(1)).alias("n"), F.sum(profit).alias("profit"), F.avg(profit).alias("roi"), F.count_if(F.col(profit) > 0).alias("wins"))


def quote_ages(quotes: DataFrame, group: list[str], quoted: str, snapshot: str) -> DataFrame:
    """AG-17, AG-18, FN-24. Exact quantiles of the quotes' ages in minutes, selected by counting; groups without an age have none."""
    age = quotes.withColumn("_age", minutes_between(quoted, snapshot))
    ends = age.groupBy(*group).agg(F.count("_age").alias("n"), F.min("_age").alias("min_age"), F.max("_age").alias("max_age"))
    middle = quantiles(age, "_age", {"median_age": 0.5, "p90_age": 0.9}, group)
    return beside(ends, middle, group, "left").select(*(f"l.{c}" for c in group), "l.n", "l.min_age", "r.median_age", "r.p90_age", "l.max_age")
