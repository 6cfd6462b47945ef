"""Model input arrays: padding, wrapping, masks, batches, and the way back to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.config import CROSS_LINE, PAD, CorpusSpec, SideFlags
from corpuslab.functions.arrays import empty_strings, let, pad_right, positions
from corpuslab.functions.text import drop_empty, plain_line
from corpuslab.operators.ranks import digest_rank


def flat_padded(tokens: Column, limit: int, end_flag: str | None = None) -> Column:
    """Flat tokens, with the end flag on the target side, cut at or filled up to the limit."""
    whole = F.concat(tokens, F.array(F.lit(end_flag))) if end_flag else tokens
    return pad_right(whole, limit, F.lit(PAD))


def wrap_line(line: Column, word_limit: int, flags: SideFlags) -> Column:
    """One line as rows of at most `word_limit` tokens; follow-up rows start with a marker."""
    end = F.array(F.lit(flags.line_end))
    first, later = word_limit - 1, word_limit - 2
    rest = F.ceil(F.greatest(F.size(line) - first, F.lit(0)) / later).cast("int")
    chunks = F.transform(
        positions(rest),
        lambda i: F.concat(
            F.array(F.lit(CROSS_LINE)), F.slice(line, i * later + first + 1, later), end
        ),
    )
    return F.concat(F.array(F.concat(F.slice(line, 1, first), end)), chunks)


def wrap_lines(matrix: Column, word_limit: int, line_limit: int, flags: SideFlags) -> Column:
    """Token matrix as exactly `line_limit` rows of exactly `word_limit` tokens."""
    closing = F.array(F.array(
        F.lit(flags.line_start), F.lit(flags.code_end), F.lit(flags.line_end)
    ))
    rows = F.concat(
        F.flatten(F.transform(drop_empty(matrix), lambda x: wrap_line(x, word_limit, flags))),
        closing,
    )
    padded = pad_right(rows, line_limit, empty_strings())
    return F.transform(padded, lambda r: pad_right(r, word_limit, F.lit(PAD)))


def word_mask(row: Column) -> Column:
    """1 where a token is padding."""
    return F.transform(row, lambda t: (t == PAD).cast("int"))


def line_mask(row: Column) -> Column:
    """1 when the whole row is padding."""
    return F.forall(row, lambda t: t == PAD).cast("int")


def output_lines(matrix: Column, spec: CorpusSpec, subword: bool = True) -> Column:
    """Decoder output back to code lines.

    An end flag ends its row, a code end also the snippet. A cross-line marker takes the
    previous line in front. Empty rows stay until the end, so that a marker after one does not
    reach further back; then they are dropped.
    """
    sides = [spec.flags1, spec.flags2]
    code_ends = [s.code_end for s in sides]
    ends = [s.line_end for s in sides] + code_ends
    silent = [PAD] + [s.line_start for s in sides] + [s.code_start for s in sides]
    nested = F.array().cast("array<array<string>>")

    def state(lines: Column, row: Column) -> Column:
        return F.struct(lines.alias("lines"), row.alias("row"))

    def put(acc: Column, token: Column) -> Column:
        lines, row = acc.getField("lines"), acc.getField("row")
        held = F.size(lines)
        pulled = state(
            F.slice(lines, F.lit(1), F.greatest(held - 1, F.lit(0))),
            F.concat(row, F.coalesce(F.get(lines, held - 1), empty_strings())),
        )
        return F.when(token == CROSS_LINE, pulled).otherwise(
            state(lines, F.concat(row, F.array(token)))
        )

    def add_row(acc: Column, row: Column) -> Column:
        def with_stop(stop: Column) -> Column:
            shown = F.filter(
                F.slice(row, F.lit(1), stop), lambda t: ~t.isin(silent + ends)
            )
            placed = F.aggregate(shown, state(acc.getField("lines"), empty_strings()), put)
            return let(
                placed,
                lambda p: F.struct(
                    F.concat(p.getField("lines"), F.array(p.getField("row"))).alias("lines"),
                    F.coalesce(F.get(row, stop).isin(code_ends), F.lit(False)).alias("done"),
                ),
            )

        first_end = F.array_min(
            F.filter(positions(F.size(row)), lambda i: F.get(row, i).isin(ends))
        )
        return F.when(acc.getField("done"), acc).otherwise(
            let(F.coalesce(first_end, F.size(row)), with_stop)
        )

    lines = F.aggregate(
        matrix,
        F.struct(nested.alias("lines"), F.lit(False).alias("done")),
        add_row,
        lambda acc: acc.getField("lines"),
    )
    to_text = plain_line if subword else (lambda x: F.array_join(x, ""))
    return F.transform(F.filter(lines, lambda x: F.size(x) > 0), to_text)


def reverse_pairs(pairs: DataFrame, spec: CorpusSpec) -> tuple[DataFrame, CorpusSpec]:
    """Swap the two sides and their flags."""
    swapped = pairs.withColumns({"key1": F.col("key2"), "key2": F.col("key1")})
    return swapped, spec.reversed()


def assign_batches(df: DataFrame, key: str, size: int, seed: int = 0,
                   within: str | None = None, digits: int = 3) -> DataFrame:
    """Shuffle by a seeded digest and number batches of `size`, per split if `within` is given.

    Rows are numbered in 16**`digits` pieces, so a piece is a task's work for up to billions of rows.
    """
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")).cast("binary"))
    ranked = digest_rank(df, order, [F.col(key)], [within] if within else [], digits)
    return ranked.withColumn("batch", F.floor((F.col("rank") - 1) / size))


def sample_batches(batched: DataFrame, count: int, epoch: int = 0) -> DataFrame:
    """The `count` batches of an epoch: those after the last epoch's, from the start again after the
    last one. All batches where there are fewer."""
    total = batched.agg((F.max("batch") + 1).alias("_total")).withColumn("_all", F.lit(0))
    ahead = F.col("batch") - F.lit(epoch * count) % F.col("_total") + F.col("_total")
    return batched.withColumn("_all", F.lit(0)).join(total, "_all").filter(
        ahead % F.col("_total") < count
    ).drop("_all", "_total")
