"""Language-model targets (W3): each token's target is the next token of
the same text (``label_for_lm``).

The reference's notion is a shift by one inside a text.  Because a text is
one row, the shift is computed inside the row (``get(tokens, i + 1)`` in a
``transform``) before exploding: no window, no shuffle, linear in the text
length, whole texts.

A language model is trained on batches of one long stream: all texts one after
the other, dealt over ``batch_size`` columns of equal length, read ``window``
tokens at a time.  Where a text lies in the stream follows from the numbers of
tokens before it, so texts are cut where a column or a window ends and only
the pieces move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import running_total, with_ordinal


def next_token_pairs(toks: DataFrame, id_col: str = "id", tokens_col: str = "tokens") -> DataFrame:
    """``id, pos, token, next_token`` (null after the last token)."""
    t = F.col(tokens_col)
    pairs = F.transform(t, lambda x, i: F.struct(x.alias("token"), F.get(t, i + 1).alias("next_token")))
    # posexplode_outer + filter: a plain posexplode would make Catalyst push
    # an inferred size(...) > 0 filter, with the tokenisation, below a repartition
    ex = toks.select(id_col, F.posexplode_outer(pairs).alias("pos", "_p")).where(F.col("pos").isNotNull())
    return ex.select(id_col, "pos", "_p.token", "_p.next_token")


def stream_windows(toks: DataFrame, batch_size: int = 48, window: int = 70, id_col: str = "id",
                   tokens_col: str = "tokens") -> DataFrame:
    """Pieces of texts by their place in the batches (W3 with W2): ``batch``,
    ``row``, ``position`` (of the first token in its window), ``tokens``,
    ``targets`` (each token's next in the stream).

    The stream of T tokens has T - 1 with a target; column ``row`` holds those
    from ``row * L`` on, L = ceil((T - 1) / batch_size), so the last column may be
    shorter and no token is left out.  Texts follow each other by id; texts
    without tokens take no place.  Only ids, token counts and first tokens are
    range-sorted; a text moves once, with its place, and a piece is never
    longer than ``window``.
    """
    if batch_size < 1 or window < 1:
        raise ValueError("batch_size and window must be >= 1")
    texts = toks.select(F.col(id_col).alias("id"), F.col(tokens_col).alias("tokens")).where(F.size("tokens") > 0)
    narrow = texts.select("id", F.size("tokens").cast("long").alias("n"), F.element_at("tokens", 1).alias("first"))
    placed = running_total(narrow, ["id"], "n", name="start", total="total")
    order = with_ordinal(placed, ["id"], name="pos")
    after = order.select((F.col("pos") - 1).alias("pos"), F.col("first").alias("following"))
    placed = order.join(after, "pos", "left").select("id", "start", "total", "following")
    length = F.ceil((F.col("total") - 1) / F.lit(batch_size))
    full = texts.join(placed, "id").withColumn("L", length).withColumn("per", F.ceil(F.col("L") / F.lit(window)))
    # The last token of the stream has no target.
    full = full.withColumn("end", F.least(F.col("start") + F.size("tokens"), F.col("total") - 1)).where("end > start")

    def number(at):
        return F.expr(f"({at} div L) * per + ({at} % L) div {window}")

    cuts = full.select("*", F.explode(F.sequence(number("start"), number("(end - 1)"))).alias("w"))
    cuts = cuts.withColumns({"row": F.expr("w div per"), "batch": F.expr("w % per")})
    cuts = cuts.withColumn("from", F.expr(f"row * L + batch * {window}")).withColumn(
        "to", F.expr(f"least(from + {window}, (row + 1) * L, end)")).withColumn("at", F.expr("greatest(from, start)"))
    size, first = F.expr("cast(to - at as int)"), F.expr("cast(at - start as int) + 1")
    following = F.concat(F.slice("tokens", first + 1, size), F.when(
        F.expr("to - start = size(tokens)"), F.array("following")).otherwise(F.expr("slice(tokens, 1, 0)")))
    return cuts.select(F.col("batch").cast("long").alias("batch"), F.col("row").cast("long").alias("row"),
                       F.expr("cast(at - from as int)").alias("position"), F.slice("tokens", first, size).alias("tokens"),
                       following.alias("targets"))


def stream_batches(toks: DataFrame, batch_size: int = 48, window: int = 70, id_col: str = "id",
                   tokens_col: str = "tokens") -> DataFrame:
    """``batch, row, position, token, target``: :func:`stream_windows`, a row per token."""
    cut = stream_windows(toks, batch_size, window, id_col, tokens_col)
    return cut.select("batch", "row", F.col("position").alias("_first"), F.posexplode(
        F.arrays_zip(F.col("tokens").alias("token"), F.col("targets").alias("target"))).alias("_k", "_t")).select(
        "batch", "row", (F.col("_first") + F.col("_k")).alias("position"), "_t.token", "_t.target")
