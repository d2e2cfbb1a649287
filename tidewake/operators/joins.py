"""Join operators. Interval joins are equi joins on the token and a time bucket, so no pair outside a bucket is built.

Nulls in join keys match nothing. Broadcasts are left to the size check of the caller; all hints here are merge joins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.operators import windows as W
from tidewake.operators.pair_blocks import co_blocks, co_pairs_in_blocks, n_blocks, pairs_in_blocks
from tidewake.sources.shared import kept


def valid_flows(flows: DataFrame, tx: DataFrame) -> DataFrame:
    """SRC-15, JOIN-1: flows whose transaction (signature, wallet) has no error; without a transaction they stay. Repeated transactions repeat flows."""
    t = tx.select(F.col("signature").alias("_s"), F.col("wallet").alias("_w"), F.col("err").alias("tx_err"))
    x = flows.join(t.hint("merge"), (F.col("signature") == F.col("_s")) & (F.col("wallet") == F.col("_w")), "left")
    return x.where("tx_err IS NULL OR tx_err = ''").drop("_s", "_w", "tx_err")


def entry_delta(trades: DataFrame) -> DataFrame:
    """JOIN-2: seconds from a token's first trade to each wallet's first buy in it."""
    start = trades.groupBy("token").agg(F.min("bt").alias("first_trade"))
    buys = trades.where("flow_direction = 'in'").groupBy("wallet", "token").agg(F.min("bt").alias("first_buy"))
    return buys.join(start.hint("merge"), "token").withColumn("delta", F.col("first_buy") - F.col("first_trade"))


def first_swap_delta(trades: DataFrame, swaps: DataFrame) -> DataFrame:
    """JOIN-3: seconds from the first swap of a trade's token to its entry; null where the token has no swap."""
    first = swaps.groupBy("token").agg(F.min("bt").alias("first_swap"))
    return trades.join(first.hint("merge"), "token", "left").withColumn("delta", F.col("bt") - F.col("first_swap"))


def liquidity_share(spends: DataFrame, liquidity: DataFrame, how: str = "inner") -> DataFrame:
    """JOIN-4: spent as a share of the token's liquidity; rows of non-positive liquidity go (inner) or get null (left)."""
    l = liquidity.where("liquidity > 0").select("token", "liquidity")  # noqa: E741
    return spends.join(l.hint("merge"), "token", how).withColumn("share", F.col("spent") / F.col("liquidity"))


def deltas_by_signature(wanted: DataFrame, tx: DataFrame) -> DataFrame:
    """JOIN-5: sum of the SOL deltas of the wanted (wallet, token, signature) over their transactions."""
    t = tx.select("wallet", "signature", "delta")
    return wanted.join(t.hint("merge"), ["wallet", "signature"]).groupBy("wallet", "token").agg(F.sum("delta").alias("delta"), F.count("*").alias("n_tx"))


#: A chunk of time in nearest() is so many times as long as what a row can see.
NEAREST_CHUNK = 16


def nearest(left: DataFrame, right: DataFrame, within: int = 60, time: str = "bt", right_time: str = "mcap_time", value: str = "mcap", key: str = "token", parts: int | None = None) -> DataFrame:
    """JOIN-6: value of the right row nearest in time within so many seconds; of two equally near the later one, then the larger value.

    Both sides are put in order in chunks of time, in which a left row has the right row before and the one after it at hand, so no
    two rows are paired; right rows are dealt to the chunks that can see them. Left rows without a match keep null. parts: how many
    partitions the chunks are dealt to.
    """
    chunk = NEAREST_CHUNK * (2 * within + 1)
    at = F.col(right_time)
    r = right.where(F.col(value).isNotNull() & F.col(key).isNotNull() & at.isNotNull())
    r = r.withColumn("_b", F.explode(F.sequence(F.floor((at - within) / chunk), F.floor((at + within) / chunk))))
    r = r.select(F.col(key).alias("_k"), "_b", at.alias("_t"), F.struct(at.alias("t"), F.col(value).alias("v")).alias("_r"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"))
    l = left.select(F.col(key).alias("_k"), F.floor(F.col(time) / chunk).alias("_b"), F.col(time).alias("_t"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.struct(*left.columns).alias("_l"))  # noqa: E741
    x = l.unionByName(r)
    x = x.repartition("_k", "_b") if parts is None else x.repartition(parts, "_k", "_b")
    # rows of equal times: the one with the largest value is the last on either way
    by = lambda *order: Window.partitionBy("_k", "_b").orderBy(*order, F.expr("_l IS NOT NULL"), F.col("_r.v")).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_p", F.last("_r", True).over(by(F.asc("_t")))).withColumn("_q", F.last("_r", True).over(by(F.desc("_t")))).where("_l IS NOT NULL")
    back, on = F.col("_t") - F.col("_p.t"), F.col("_q.t") - F.col("_t")
    later = (on <= within) & (F.col("_p").isNull() | (on <= back))
    found = F.when(later, F.col("_q")).when(back <= within, F.col("_p"))
    return x.select("_l.*", found.alias("_f")).select(*left.columns, F.col("_f.v").alias(value), F.col("_f.t").alias(right_time))


def interval(left: DataFrame, right: DataFrame, before: int, after: int, key: str = "token", width: int | None = None) -> DataFrame:
    """Pairs of left and right rows with equal keys and left.at - before <= right.bt <= left.at + after.

    left: key, at and other columns; right: key, bt and columns of other names. Left rows are dealt to the buckets of time
    that their interval touches.
    """
    width = width or before + after + 1
    a = left.withColumn("_b", F.explode(F.sequence(F.floor((F.col("at") - before) / width), F.floor((F.col("at") + after) / width))))
    b = right.withColumnRenamed(key, "_k").withColumn("_rb", F.floor(F.col("bt") / width))
    x = a.join(b.hint("merge"), (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_rb")) & F.col("bt").between(F.col("at") - before, F.col("at") + after))
    return x.drop("_b", "_rb", "_k")


def co_wallets(anchors: DataFrame, buys: DataFrame, within: int = 30, blocks: bool | None = None) -> DataFrame:
    """JOIN-7: for each other wallet that bought within so many seconds of an anchor's buy: number of tokens and of buys shared.

    Where anchors are the buys themselves and their wallets meet often, they meet in blocks (pair_blocks), so only finished pairs
    leave a task; blocks: whether they do. If not given, the rows that either way moves decide. The result is the same.
    """
    if anchors is buys and blocks is not False and buys.schema["bt"].dataType.simpleString() in ("bigint", "int"):
        own = kept(buys.select("wallet", "token", "bt"), "co-buys")
        n_rows, chunk = own.count(), F.floor(F.col("bt") / (2 * within + 1))
        n = co_blocks(n_rows)
        met = own.groupBy("token", chunk.alias("_b")).agg(F.count("*").cast("double").alias("_c")).agg(F.sum(F.col("_c") * F.col("_c"))).first()[0] or 0.0
        if blocks or met > n * n_rows:
            return co_pairs_in_blocks(own, "wallet", "token", "bt", within, n).select(F.col("a").alias("anchor"), F.col("b").alias("wallet"), "n_tokens", "n_pairs")
        anchors = buys = own
    a = anchors.select(F.col("wallet").alias("anchor"), "token", F.col("bt").alias("at"))
    x = interval(a, buys.select("token", "wallet", "bt"), within, within).where("wallet <> anchor")
    # a token of a pair first: no set of tokens for each pair
    x = x.groupBy("anchor", "wallet", "token").agg(F.count("*").alias("_c")).groupBy("anchor", "wallet")
    return x.agg(F.count("token").alias("n_tokens"), F.sum("_c").alias("n_pairs"))


def pre_entry(entries: DataFrame, flows: DataFrame, before: int = 10, around: int = 30) -> DataFrame:
    """JOIN-8: distinct buyers in [-before, 0) of each entry (entry, token, at), buys and sells within around, and their imbalance."""
    x = interval(entries, flows.select("token", "wallet", "bt", "direction"), around, around)
    early = F.col("bt").between(F.col("at") - before, F.col("at") - 1) & (F.col("direction") == "buy")
    buys, sells = F.count_if(F.col("direction") == "buy"), F.count_if(F.col("direction") == "sell")
    y = x.groupBy("entry", "token", "at").agg(F.countDistinct(F.when(early, F.col("wallet"))).alias("buyers_before"), buys.alias("n_buys"), sells.alias("n_sells"))
    return y.withColumn("imbalance", (F.col("n_buys") - F.col("n_sells")) / F.greatest(F.col("n_buys") + F.col("n_sells"), F.lit(1)))


def trade_windows(trades: DataFrame, swaps: DataFrame, pad: int = 60) -> DataFrame:
    """JOIN-9: swaps of a trade's token in [entry - pad, exit + pad]: number and lamports for each trade (trade, token, entry, exit)."""
    width = 6 * 3600
    a = trades.withColumn("_b", F.explode(F.sequence(F.floor((F.col("entry") - pad) / width), F.floor((F.col("exit") + pad) / width))))
    b = swaps.select(F.col("token").alias("_k"), "bt", "lamports").withColumn("_rb", F.floor(F.col("bt") / width))
    on = (F.col("token") == F.col("_k")) & (F.col("_b") == F.col("_rb")) & F.col("bt").between(F.col("entry") - pad, F.col("exit") + pad)
    return a.join(b.hint("merge"), on).groupBy("trade", "token").agg(F.count("*").alias("n_swaps"), F.sum("lamports").alias("lamports"))


def first_buys(trades: DataFrame) -> DataFrame:
    """AGG-11 part: first buy of each wallet in each token."""
    return trades.where("flow_direction = 'in'").groupBy("wallet", "token").agg(F.min("bt").alias("first_buy"))


#: Rows of a key in one block where two large sides of it meet.
PAIR_BLOCK = 512


def dealt_join(left: DataFrame, right: DataFrame, key: str, block: int = PAIR_BLOCK) -> DataFrame:
    """Inner join on key (a text or number) where both sides may be hot: the rows of a key are dealt to blocks of about block rows, and each pair of blocks meets in a task of its own. Other columns have different names."""
    blocks = lambda df, name: df.groupBy(F.col(key).alias("_k")).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = blocks(left, "_nl").join(blocks(right, "_nr").hint("merge"), "_k")
    dealt = lambda df, own, n, over, m: (
        df.join(sizes.hint("merge"), F.col(key) == F.col("_k")).withColumn(own, F.pmod(F.xxhash64(*[c for c in df.columns if c != key]), F.col(n))).withColumn(over, F.explode(F.sequence(F.lit(0), F.col(m) - 1))).drop("_k", "_nl", "_nr")
    )
    a, b = dealt(left, "_bi", "_nl", "_bj", "_nr"), dealt(right, "_bj", "_nr", "_bi", "_nl")
    return a.join(b.hint("merge"), [key, "_bi", "_bj"]).drop("_bi", "_bj")


def _ranked(sets: DataFrame, key: str, item: str) -> DataFrame:
    """Distinct (key, item) with _n, the items of the key, and _row, the item's number in it from the rarest on.

    Items are ordered by the power of two of their frequency and a hash, the same for all keys; numbers come from chunks of that order.
    """
    often = sets.groupBy(F.col(item).alias("_i")).agg(F.floor(F.log2(F.count("*"))).cast("long").alias("_often"))
    sizes = sets.groupBy(F.col(key).alias("_s")).agg(F.count("*").alias("_n"))
    x = sets.join(often.hint("merge"), F.col(item) == F.col("_i")).join(sizes.hint("merge"), F.col(key) == F.col("_s")).drop("_i", "_s")
    x = x.withColumn("_order", F.shiftleft("_often", 56).bitwiseOR(F.shiftrightunsigned(F.xxhash64(item), 8)))
    return W.numbered(x, key, "_order", item, 1 << 51).drop("_order", "_often")


def _shared(candidates: DataFrame, sets: DataFrame, key: str, item: str) -> DataFrame:
    """(a, b, item) of the items that the keys of each candidate pair (a, b, with _n of a the smaller) have in common."""
    own = sets.select(F.col(key).alias("a"), item)
    other = sets.select(F.col(key).alias("b"), item)
    return candidates.join(own.hint("merge"), "a").join(other.hint("merge"), ["b", item])


#: A prefix is looked up where its pairs are at most this share of all pairs with an item in common; else counting all of them is less work.
PAYS = 0.25


def _pairs_formed(left: DataFrame, right: DataFrame, item: str) -> float:
    """How many pairs of rows of equal items there are."""
    count = lambda df, name: df.groupBy(F.col(item).alias("_i")).agg(F.count("*").cast("double").alias(name))
    return count(left, "_x").join(count(right, "_y").hint("merge"), "_i").agg(F.sum(F.col("_x") * F.col("_y"))).first()[0] or 0.0


def _long_prefix(ranked: DataFrame, least: int) -> DataFrame:
    """Of _ranked() rows, those without which no least items can be shared."""
    return ranked.where(F.col("_n") >= least).where(F.col("_row") < F.col("_n") - (least - 1))


#: A task forms so many shared items in the time in which a row of a candidate is moved and counted.
FORMED = 50


def _rare_pays(rare: Callable[[], DataFrame], prefix: Column, both: bool, sets: DataFrame, key: str, item: str) -> bool:
    """Whether prefixes (rare, of prefix rows of a key's _n) that meet each other, or (if not both) whole sets, are less work than all pairs, joined or in blocks of keys. Prefixes are not taken where any of so many rows would form too many pairs."""
    whole = _pairs_formed(sets, sets, item)
    n_keys, n_items = _size(sets, key, item)
    pays = lambda formed: formed <= PAYS * whole and (formed <= BLOCKS_PAY * n_blocks(n_keys, n_items) * n_items or whole > FORMED * formed)
    n_rows = sets.groupBy(key).agg(F.count("*").alias("_n")).agg(F.sum(F.greatest(prefix, F.lit(0)).cast("double"))).first()[0] or 0.0
    # rows over so many items form the fewest pairs where each item has as many of them
    if not pays(n_rows * n_rows / max(1, sets.select(item).distinct().count())):
        return False
    some = rare()
    return pays(_pairs_formed(some, some if both else sets, item))


def _size(sets: DataFrame, key: str, item: str) -> tuple[int, int]:
    """How many keys and items there are."""
    n_keys, n_items = sets.groupBy(key).agg(F.count(item).alias("_n")).agg(F.count("*"), F.sum("_n")).first()
    return n_keys, n_items or 0


def prefix_pays(sets: DataFrame, least: int, key: str = "wallet", item: str = "token") -> bool:
    """Whether most of the pairs that share an item need not be formed to find those that share least items."""
    if least <= 1:
        return False
    sets = sets.select(key, item)
    return _rare_pays(lambda: _long_prefix(_ranked(sets, key, item), least), F.col("_n") - (least - 1), True, sets, key, item)


#: Pairs meet in blocks of keys where so many more rows of equal items would be joined than keys with their items are moved to the blocks.
BLOCKS_PAY = 8


def blocks_for(sets: DataFrame, key: str, item: str, blocks: bool | None = None) -> int:
    """How many blocks of keys to compare, or 0 where joining the items forms fewer rows; blocks as in sharing_pairs()."""
    if blocks is False or not str(sets.schema[key].dataType).startswith(("String", "Long", "Integer")):
        return 0
    n_keys, n_items = _size(sets, key, item)
    n = n_blocks(n_keys, n_items)
    return n if blocks or _pairs_formed(sets, sets, item) > BLOCKS_PAY * n * n_items else 0


def all_pairs(sets: DataFrame, least: int, key: str, item: str, blocks: bool | None = None, share: float = 0.0) -> DataFrame:
    """(a, b, na, nb, shared) as sharing_pairs(), with the sizes of both sets, from all pairs that share an item; share: and at least that share of the smaller set."""
    if n := blocks_for(sets, key, item, blocks):
        return pairs_in_blocks(sets, key, item, least=least, blocks=n, share=share)
    sizes = sets.groupBy(F.col(key).alias("_s")).agg(F.count("*").alias("_m"))
    a, b = sets.withColumnRenamed(key, "a"), sets.withColumnRenamed(key, "b")
    x = dealt_join(a, b, item).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    for end in ("a", "b"):
        x = x.join(sizes.withColumnRenamed("_m", f"n{end}").hint("merge"), F.col(end) == F.col("_s")).drop("_s")
    return x.select("a", "b", "na", "nb", "shared").where(F.col("shared") / F.least("na", "nb") >= share)


def sharing_pairs(sets: DataFrame, least: int, key: str = "wallet", item: str = "token", prefix: bool | None = None, blocks: bool | None = None) -> DataFrame:
    """(a, b, shared), a < b: pairs of keys that share at least so many items of distinct sets (key, item).

    Two sets that share so many items share one beside the least - 1 most frequent items of each, so only pairs that meet in
    such a prefix are counted; keys with fewer items are left out first. A frequent item's holders meet in blocks. prefix: whether to go
    that way; if not given, the pairs that it forms decide (prefix_pays). blocks: whether all pairs, where they are wanted, are
    formed in blocks of keys (pair_blocks) or by joining the items; if not given, the rows of either way decide. The result is the same.
    """
    sets = kept(sets.select(key, item), "pair-sets")
    if not (prefix_pays(sets, least, key, item) if prefix is None else prefix and least > 1):
        return all_pairs(sets, least, key, item, blocks).select("a", "b", "shared")
    x = _long_prefix(_ranked(sets, key, item), least)
    a, b = x.select(F.col(key).alias("a"), item, F.col("_n").alias("na")), x.select(F.col(key).alias("b"), item, F.col("_n").alias("nb"))
    met = dealt_join(a, b, item).where("a < b").select("a", "b", "na", "nb").distinct()
    # the smaller set of a pair is looked up in the larger one
    turned = met.select(F.when(F.col("na") <= F.col("nb"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("na") <= F.col("nb"), F.col("b")).otherwise(F.col("a")).alias("b"))
    counts = _shared(turned, sets, key, item).groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    return counts.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared")


def overlap_join(sets: DataFrame, least: float = 0.5, key: str = "wallet", item: str = "token", prefix: bool | None = None, blocks: bool | None = None) -> DataFrame:
    """JOIN-11 as a set-similarity join: pairs a < b whose shared items are at least that share of the smaller set, with shared and overlap.

    Of the smaller set only a prefix is looked up, rarest items first: without one of its n - ceil(least n) + 1 rarest items a
    pair cannot reach the bound. Candidates are counted exactly. Pairs that share nothing are no rows. prefix and blocks as in sharing_pairs().
    """
    sets = kept(sets.select(key, item), "pair-sets")
    ranked = _ranked(sets, key, item)
    length = F.col("_n") - F.ceil(F.lit(least) * F.col("_n") - 1e-9) + 1
    rare = ranked.where(F.col("_row") < length)
    if not (_rare_pays(lambda: rare, length, False, sets, key, item) if prefix is None else prefix):
        x = all_pairs(sets, 1, key, item, blocks, least)
        return x.select("a", "b", "shared", (F.col("shared") / F.least("na", "nb")).alias("overlap"))
    rare, whole = rare.select(F.col(key).alias("a"), item, F.col("_n").alias("na")), ranked.select(F.col(key).alias("b"), item, F.col("_n").alias("nb"))
    met = dealt_join(rare, whole, item).where((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))).select("a", "b", "na").distinct()
    x = _shared(met, sets, key, item).groupBy("a", "b", "na").agg(F.count("*").alias("shared")).withColumn("overlap", F.col("shared") / F.col("na")).where(F.col("overlap") >= least)
    return x.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared", "overlap")


def pair_stats(firsts: DataFrame, wallets: DataFrame | None = None, least_shared: int = 1, blocks: bool | None = None) -> DataFrame:
    """JOIN-10, AGG-12: for wallets a < b with at least least_shared tokens in common: how many, how often a led, median and nearest-rank p90 of b's delay.

    wallets: the wallets to compare with each other, a list of bounded size; all others are left out before the join. With a
    least_shared above 1 the tokens that pairs share are counted first (sharing_pairs), and delays are gathered only for the
    pairs that reach it; with 1, or where wallets share so many tokens that nearly all pairs must be formed, all are; blocks as in sharing_pairs().
    """
    firsts = firsts.select("wallet", "token", "first_buy")
    if wallets is not None:
        firsts = firsts.join(wallets.select("wallet").distinct().hint("broadcast"), "wallet", "left_semi")
    firsts = kept(firsts, "pair-firsts")
    a = firsts.select("token", F.col("wallet").alias("a"), F.col("first_buy").alias("ta"))
    b = firsts.select("token", F.col("wallet").alias("b"), F.col("first_buy").alias("tb"))
    prefix = prefix_pays(firsts, least_shared)
    whole = firsts.schema["first_buy"].dataType.simpleString() in ("bigint", "int")
    if not prefix and whole and (n := blocks_for(firsts, "wallet", "token", blocks)):
        return pairs_in_blocks(firsts, "wallet", "token", "first_buy", least_shared, n, sizes=False)
    if prefix:
        pairs = sharing_pairs(firsts, least_shared, prefix=True).select("a", "b")
        x = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), ["b", "token"])
    else:
        x = dealt_join(a, b, "token").where("a < b")
    x = x.withColumn("delta", F.col("tb") - F.col("ta"))
    p90 = F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY delta)")
    x = x.groupBy("a", "b").agg(F.count("*").alias("shared"), (F.count_if(F.col("delta") > 0) / F.count("*")).alias("lead_rate"), F.median("delta").alias("median_delta"), p90.alias("p90_delta"))
    return x.where(F.col("shared") >= least_shared)


def token_overlap(pairs: DataFrame, wallets: DataFrame) -> DataFrame:
    """JOIN-11: shared tokens of wallets a <= b of a seed list that share any, as a share of the smaller one's number. Pairs without a row share nothing.

    pairs: distinct (wallet, token). wallets: the seeds.
    """
    own = pairs.select("wallet", "token").join(wallets.select("wallet").hint("merge"), "wallet", "left_semi")
    own = kept(own, "pair-sets")
    n = F.col("n")
    itself = own.groupBy("wallet").agg(F.count("*").alias("n")).select(F.col("wallet").alias("a"), F.col("wallet").alias("b"), n.alias("na"), n.alias("nb"), n.alias("shared"))
    x = all_pairs(own, 1, "wallet", "token").unionByName(itself)
    return x.select("a", "b", "shared", (F.col("shared") / F.least("na", "nb")).alias("overlap"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges (wallet_a, wallet_b, weight) from either end, made in one pass; a loop once."""
    end = lambda x, y: F.struct(F.col(x).alias("wallet"), F.col(y).alias("neighbour"))
    turned = F.when(F.col("wallet_a") != F.col("wallet_b"), end("wallet_b", "wallet_a"))
    x = edges.select("weight", F.explode(F.array_compact(F.array(end("wallet_a", "wallet_b"), turned))).alias("_e"))
    return x.select("_e.wallet", "_e.neighbour", "weight")


def neighbours(edges: DataFrame, seeds: DataFrame, k: int | None = None, parts: int | None = None) -> DataFrame:
    """JOIN-12, TOP-1: neighbours of the seeds with summed weights; the k heaviest of each, ties by name. parts: how many partitions the ends of the edges are dealt to."""
    x = both_ways(edges)
    x = x if parts is None else x.repartition(parts, "wallet")
    x = x.join(seeds.select("wallet").hint("merge"), "wallet", "left_semi").groupBy("wallet", "neighbour").agg(F.sum("weight").alias("weight"))
    if k is None:
        return x
    w = Window.partitionBy("wallet").orderBy(F.desc("weight"), "neighbour")
    return x.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def neighbour_wallets(edges: DataFrame, seeds: DataFrame, parts: int | None = None) -> DataFrame:
    """(wallet) of the distinct neighbours of the seeds; parts as in neighbours()."""
    x = both_ways(edges.withColumn("weight", F.lit(1)))
    x = x if parts is None else x.repartition(parts, "wallet")
    return x.join(seeds.select("wallet").hint("merge"), "wallet", "left_semi").select(F.col("neighbour").alias("wallet")).distinct()


def degrees(edges: DataFrame, wallets: DataFrame) -> DataFrame:
    """JOIN-13: number of edge ends at each wanted wallet, 0 included."""
    ends = edges.select(F.explode(F.array("wallet_a", "wallet_b")).alias("wallet"))
    return wallets.select("wallet").join(ends.groupBy("wallet").agg(F.count("*").alias("degree")).hint("merge"), "wallet", "left").fillna(0, ["degree"])


def shared_groups(members: DataFrame, seeds: DataFrame) -> DataFrame:
    """JOIN-14: number of other seeds that share a group with each seed.

    Seeds of the same groups are one class with their number, so classes meet, not seeds.
    """
    own = members.join(seeds.select("wallet").hint("merge"), "wallet", "left_semi").where(F.col("wallet").isNotNull())
    own = own.groupBy("wallet").agg(F.array_sort(F.collect_set("group_id")).alias("groups")).where(F.size("groups") > 0)
    classes = own.groupBy("groups").agg(F.count("*").alias("_c"))
    one = classes.select("groups", F.explode("groups").alias("group_id"))
    two = classes.select(F.col("groups").alias("_others"), "_c", F.explode("groups").alias("group_id"))
    met = dealt_join(one, two, "group_id").select("groups", "_others", "_c").distinct().groupBy("groups").agg((F.sum("_c") - 1).alias("n_shared"))
    x = own.join(met.hint("merge"), "groups").select("wallet", "n_shared")
    return seeds.select("wallet").join(x.hint("merge"), "wallet", "left").fillna(0, ["n_shared"])


#: Steps of sources that a task follows further.
STEP_ROWS = 100_000
#: Seconds of transfers of a pair of wallets that are held together.
TRANSFER_CHUNK = 86_400


#: Rows of a table that is sent whole to each executor, after they were counted.
SENT_ROWS = 200_000


def beside(df: DataFrame, most: int | None = None) -> DataFrame:
    """df for a join: broadcast if it has at most so many rows, counted; else with a merge hint. df should be stored."""
    limit = SENT_ROWS if most is None else most
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df.hint("merge")


def funding_routes(transfers: DataFrame, creators: DataFrame, targets: DataFrame, depth: int = 2, block: int = PAIR_BLOCK, most: int | None = None, path: bool = True) -> DataFrame:
    """JOIN-18: shortest time-ordered paths (source, target, hops, arrival, path) of at most depth transfers from a creator to a target.

    transfers: (src, dst, bt), repeated or not. path: the wallets in between, if wanted. Of equal hops the path with the earliest arrival
    stays, then the first by name. The first step is the earliest transfer of each two wallets. Later ones take the
    transfers of the wallets reached. If these are few (most, by default SENT_ROWS), each task has all of them and the steps
    of its sources, so only the best way to each receiver leaves it. Else they are a row for each two wallets and day, of which
    at most one can hold the next transfer, and a hub's senders and receivers meet in blocks.
    """
    spark, limit, way = transfers.sparkSession, SENT_ROWS if most is None else most, ["path"] if path else []
    day = F.floor(F.col("bt") / TRANSFER_CHUNK)
    wanted = beside(kept(targets.select(F.col("wallet").alias("dst")).distinct(), "funding-targets"), most)
    creators = beside(kept(creators.select(F.col("wallet").alias("source")).distinct(), "funding-sources"), most)
    first = transfers.select(F.col("src").alias("source"), "dst", "bt").where("source IS NOT NULL AND dst <> source AND bt IS NOT NULL")
    if depth == 1:
        first = first.join(wanted, "dst", "left_semi")
    first = first.join(creators, "source", "left_semi").groupBy("source", F.col("dst").alias("src")).agg(F.min("bt").alias("since"))
    front = kept(first.withColumn("path", F.array().cast("array<string>")) if path else first, "funding-steps")
    found = front.select("source", F.col("src").alias("target"), F.lit(1).alias("hops"), "since", *way)
    for hop in range(2, depth + 1):
        reached = beside(kept(front.select("src").distinct(), "funding-reached"), most)
        sent = transfers.join(reached, "src", "left_semi")
        # only the last step may leave out receivers that are no targets
        sent = sent if hop < depth else sent.join(wanted, "dst", "left_semi")
        by = Window.partitionBy("src", "dst")
        each = sent.select("src", "dst", "bt").where("bt IS NOT NULL").distinct().withColumn("_lo", F.lag("bt").over(by.orderBy("bt")))
        each = kept(each, "funding-sent")
        if each.limit(limit + 1).count() <= limit:
            n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-front.count() // STEP_ROWS))
            step = front.repartition(n, "source").join(F.broadcast(each.withColumn("_hi", F.col("bt"))), "src")
            at = F.col("bt")
        else:
            t = each.groupBy("src", "dst", day.alias("_day")).agg(F.collect_list("bt").alias("times"), F.max("bt").alias("_hi"), F.min("bt").alias("_least"))
            t = t.withColumn("_lo", F.lag("_hi").over(by.orderBy("_least"))).select("src", "dst", "times", "_lo", "_hi")
            step = dealt_join(front, t, "src", block)
            at = F.array_min(F.filter("times", lambda x: x >= F.col("since")))
        step = step.where((F.col("since") <= F.col("_hi")) & (F.col("_lo").isNull() | (F.col("since") > F.col("_lo"))) & (F.col("dst") != F.col("source")))
        step = step.select("source", F.col("dst").alias("src"), at.alias("since"), *([F.concat("path", F.array("src")).alias("path")] if path else [])).groupBy("source", "src")
        front = step.agg(F.min(F.struct("since", "path")).alias("p")).select("source", "src", "p.*") if path else step.agg(F.min("since").alias("since"))
        front = front if hop == depth else kept(front, "funding-steps")
        found = found.unionByName(front.select("source", F.col("src").alias("target"), F.lit(hop).alias("hops"), "since", *way))
    best = found.groupBy("source", "target").agg(F.min(F.struct("hops", "since", *way)).alias("p"))
    best = best.join(wanted.withColumnRenamed("dst", "target"), "target", "left_semi")
    return best.select("source", "target", "p.hops", F.col("p.since").alias("arrival"), *[f"p.{c}" for c in way])


def funding_paths(transfers: DataFrame, creators: DataFrame, targets: DataFrame, depth: int = 2) -> DataFrame:
    """JOIN-18: funding_routes() without the wallets in between."""
    return funding_routes(transfers, creators, targets, depth, path=False)


def deployer_history(flows: DataFrame, wins: DataFrame) -> DataFrame:
    """JOIN-21: for each deployer: tokens deployed and the share of them that were fast wins. flows: (token, deployer); wins: (token, fast_win)."""
    x = flows.select("token", "deployer").distinct().join(wins.hint("merge"), "token")
    return x.groupBy("deployer").agg(F.count("*").alias("n_tokens"), F.avg(F.col("fast_win").cast("int")).alias("fast_win_rate"))


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """JOIN-25, SET-6: rows that one table has more often than the other, with side and count."""
    cols = left.columns
    x = left.groupBy(*cols).agg(F.count("*").alias("_n")).unionAll(right.select(*cols).groupBy(*cols).agg((-F.count("*")).alias("_n")))
    y = x.groupBy(*cols).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return y.select(*cols, F.when(F.col("_n") > 0, "left").otherwise("right").alias("side"), F.abs("_n").alias("n"))


def named(df: DataFrame, names: DataFrame, wallet: str = "wallet") -> DataFrame:
    """JOIN-24: df with name, the wallet's own text where it has none."""
    n = names.groupBy("address").agg(F.min("name").alias("_name"))
    x = df.join(n.hint("merge"), F.col(wallet) == F.col("address"), "left")
    return x.withColumn("name", F.coalesce("_name", wallet)).drop("address", "_name")


