"""Position-wise fusion of many reads into one identifier per session.

Plan: reads are shuffled once, by session, and become one row per session; votes, choices and evidence are
expressions on its arrays, so nothing is shuffled or sorted again and a task holds a bounded number of reads. Sessions
of more than ``WHOLE_READS`` reads are apart: identical reads are merged first (session, text, evidence group, variant),
votes are counted per (session, position, character), and only arrays bounded by the alphabet become one row. From the
votes on both take the same steps. The grammar is a small rule table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marktrace.functions.text import base_variant, lookup, normalize
from marktrace.operators.joins import rule_side, symmetric
from marktrace.operators.ordered import MAX_SLICES, null_safe_join
from marktrace.session import slice_rows

#: reads a session may have to become one row
WHOLE_READS = 10_000
#: reads dealt to one task
TASK_READS = 250_000

@dataclass(frozen=True)
class FusionParams:
    """Positions are 1-based. Constants, risky, serial and key positions come from the user's grammar."""

    length: int = 17
    models: tuple[str, ...] = ()
    constants: dict = field(default_factory=dict)
    prefixes: dict = field(default_factory=dict)
    prefix_width: int = 4
    trusted_variants: tuple[str, ...] = ()
    risky: tuple[int, ...] = ()
    serial: tuple[int, ...] = ()
    key: int = 5
    suspects: str = ""
    rescue_raw: str = ""
    confusion_prior: float = 0.6
    final_score: float = 0.92
    min_groups: int = 2
    multi_variant: int = 4
    strong_prob: float = 0.80
    single_read: bool = False
    single_score: float = 0.92
    risky_margin: float = 0.25
    variable_margin: float = 0.08
    serial_margin: float = 0.12
    conflict_ratio: float = 0.55
    raw_support: float = 0.60
    key_margin: float = 0.20
    key_groups: int = 2
    key_variants: int = 3
    require_known: bool = True
    rescue_conf: float = 0.74
    rescue_b: bool = True
    rescue_b_score: float = 0.90
    rescue_b_support: float = 0.85


NEEDED = ["raw_text", "evidence_group", "variant_name", "ocr_conf", "variant_weight", "crop_quality", "read_seq"]


def place_by_session(reads: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """(reads of sessions small enough for one row, shuffled once by session; the other reads, or None).

    The number of tasks follows the number of reads, so a task's share does not grow with the input. At most
    MAX_SLICES sessions are apart.
    """
    slim = reads.select(*keys, *NEEDED)
    spark = reads.sparkSession
    counts = reads.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total, top = counts.agg(F.sum("_n"), F.max("_n")).first()
    limit = min(slice_rows(spark), WHOLE_READS)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((total or 0) / TASK_READS))
    if not total or top <= limit:
        return slim.repartition(tasks, *keys), None
    big = counts.filter(F.col("_n") > max(limit, math.ceil(total / MAX_SLICES))).drop("_n").withColumn("_big", F.lit(True)).collect()
    if not big:
        return slim.repartition(tasks, *keys), None
    table = spark.createDataFrame([tuple(r) for r in big], T.StructType([*[reads.schema[k] for k in keys], T.StructField("_big", T.BooleanType())]))
    marked = null_safe_join(slim, F.broadcast(table), keys, "left")
    return marked.filter("_big is null").drop("_big").repartition(tasks, *keys), marked.filter("_big").drop("_big")


def weighed(reads: DataFrame, length: int) -> DataFrame:
    """Each read's normalised text, NULL unless complete, and its weights."""
    conf = F.greatest(F.lit(0.0), F.col("ocr_conf"))
    share = F.greatest(F.lit(0.0), F.col("variant_weight")) * F.greatest(F.lit(0.05), F.col("crop_quality"))
    text = normalize(F.col("raw_text"))
    return reads.withColumn("text", F.when(F.length(text) == length, text)).withColumns(
        {"vote": F.greatest(conf * share, F.lit(1e-6)), "weight": conf * share, "share": share}
    )


def total_of(items: Column, name: str) -> Column:
    """Sum of one field as an aggregate has it: NULLs are passed over."""
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + F.coalesce(x[name].cast("double"), F.lit(0.0)))


def distinct_of(items: Column, value) -> Column:
    """Number of distinct values, NULLs not counted."""
    return F.size(F.array_distinct(F.filter(F.transform(items, value), lambda v: v.isNotNull()))).cast("long")


def session_rows(reads: DataFrame, keys: Sequence[str], length: int) -> DataFrame:
    """One row per session: its complete reads, in a fixed order, as ``_reads``. Sessions without any keep a row."""
    one = F.struct("text", "read_seq", "evidence_group", "variant_name", "vote", "weight", "share", "ocr_conf")
    rows = weighed(reads, length).groupBy(*keys).agg(F.collect_list(F.when(F.col("text").isNotNull(), one)).alias("_reads"))
    return rows.withColumn("_reads", F.sort_array("_reads"))


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it; unlike ``transform`` it copies nothing."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda a, _: a, use)


def array_votes(reads: Column, length: int) -> Column:
    """A18 as arrays: per position its characters with weight, reads, distinct variants and groups, the heaviest first.

    Where the texts of a session agree, the one character has what all reads have together.
    """

    def counted(own: Column) -> list[Column]:
        return [
            total_of(own, "vote").alias("weight"), F.array_min(F.transform(own, lambda r: r.read_seq)).alias("seq"), F.size(own).cast("long").alias("reads"),
            distinct_of(own, lambda r: r.variant_name).alias("variants"), distinct_of(own, lambda r: r.evidence_group).alias("groups"),
        ]

    def cell(x: Column, char: Column) -> Column:
        return F.struct((-F.round(x.weight, 9)).alias("neg"), x.seq.alias("seq"), char.alias("char"), x.weight.alias("weight"), x.reads.alias("reads"), x.variants.alias("variants"), x.groups.alias("groups"))

    def position(i: Column, whole: Column) -> Column:
        at = lambda t: F.substr(t, i, F.lit(1))

        def apart(chars: Column) -> Column:
            mine = F.transform(chars, lambda ch: F.struct(ch.alias("char"), F.filter(reads, lambda r: at(r.text) == ch).alias("own")))
            return F.sort_array(F.transform(F.transform(mine, lambda x: F.struct(x.char.alias("char"), *counted(x.own))), lambda x: cell(x, x.char)))

        cells = bound(F.array_distinct(F.transform(whole.texts, at)), lambda chars: F.when(F.size(chars) == 1, F.array(cell(whole, F.get(chars, F.lit(0))))).otherwise(apart(chars)))
        return F.struct(i.alias("pos"), cells.alias("cells"))

    texts = F.array_distinct(F.transform(reads, lambda r: r.text)).alias("texts")
    return bound(F.struct(texts, *counted(reads)), lambda whole: F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: position(i, whole)))


def array_texts(reads: Column, trusted_variants: Sequence[str]) -> Column:
    """Evidence per distinct text of a session."""

    def base(r: Column) -> Column:
        b = base_variant(r.variant_name)
        return F.when(b.isin(list(trusted_variants)), b) if trusted_variants else F.lit(None).cast("string")

    mine = F.transform(F.array_distinct(F.transform(reads, lambda r: r.text)), lambda t: F.struct(t.alias("text"), F.filter(reads, lambda r: r.text == t).alias("own")))
    return F.transform(
        mine,
        lambda x: F.struct(
            x.text.alias("text"), total_of(x.own, "weight").alias("weight"), F.size(x.own).cast("long").alias("reads"), total_of(x.own, "ocr_conf").alias("conf"),
            distinct_of(x.own, lambda r: r.evidence_group).alias("groups"), distinct_of(x.own, base).alias("trusted"),
        ),
    )


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``value`` as a column that later filters and projections cannot copy: a filter on it would compute it again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def merge_reads(reads: DataFrame, keys: Sequence[str], length: int) -> DataFrame:
    """Full-length reads merged per (session, text, evidence group, variant)."""
    return merge_weighed(weighed(reads, length).filter("text is not null"), keys)


def merge_weighed(full: DataFrame, keys: Sequence[str]) -> DataFrame:
    return full.groupBy(*keys, "text", "evidence_group", "variant_name").agg(
        F.sum("vote").alias("vote"),
        F.sum("weight").alias("weight"),
        F.sum("share").alias("share"),
        F.sum("ocr_conf").alias("conf_sum"),
        F.count(F.lit(1)).alias("reads"),
        F.min("read_seq").alias("seq"),
    )


def position_votes(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weight, reads, distinct variants and evidence groups per (session, position, character)."""
    chars = cells.select("*", F.posexplode(F.split("text", "")).alias("_p", "char")).withColumn("pos", F.col("_p") + 1)
    per = chars.groupBy(*keys, "pos", "char")
    return per.agg(
        F.sum("vote").alias("weight"),
        F.sum("reads").alias("reads"),
        F.count_distinct("variant_name").alias("variants"),
        F.count_distinct("evidence_group").alias("groups"),
        F.min("seq").alias("seq"),
    )


def weighted_confidence(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A19 with read and group totals: weights leave the confidence out."""
    return cells.groupBy(*keys).agg(
        F.coalesce(F.sum("weight") / F.nullif(F.sum("share"), F.lit(0.0)), F.lit(0.0)).alias("avg_conf"),
        F.sum("reads").alias("n_reads"),
        F.count_distinct("evidence_group").alias("n_groups"),
    )


def rule_positions(rules: DataFrame, confusions: DataFrame, prior: float) -> DataFrame:
    """One row per (model, position): allowed characters and, per disallowed character with allowed
    confusable neighbours, where its weight goes."""
    r = rules.select("model", "pos", F.col("allowed_char").alias("char")).distinct()
    allowed = r.groupBy("model", "pos").agg(F.array_sort(F.collect_set("char")).alias("allowed"))
    sym = symmetric(confusions).select("char", F.col("alt").alias("to"))
    moves = r.select("model", "pos", F.col("char").alias("to")).join(sym, "to").join(r.withColumn("_ok", F.lit(1)), ["model", "pos", "char"], "left_anti")
    lists = moves.groupBy("model", "pos", "char").agg(F.array_sort(F.collect_set("to")).alias("to"))
    share = F.transform("to", lambda t: F.struct(t.alias("to"), (F.lit(prior) / F.size("to")).alias("share")))
    table = lists.groupBy("model", "pos").agg(F.collect_list(F.struct("char", share.alias("to"))).alias("moves"))
    return allowed.join(table, ["model", "pos"], "left")


def votes_per_session(reads: DataFrame, keys: Sequence[str], length: int, trusted: Sequence[str] = ()) -> DataFrame:
    """Per session: ``positions`` (NULL without a complete read), confidence and totals, and ``texts`` with their evidence."""
    rows = session_rows(reads, keys, length)
    r = F.col("_reads")
    some = F.size(r) > 0
    share = total_of(r, "share")
    return rows.select(
        *keys, F.when(some, array_votes(r, length)).alias("positions"), F.when(some, F.coalesce(total_of(r, "weight") / F.nullif(share, F.lit(0.0)), F.lit(0.0))).alias("avg_conf"),
        F.size(r).cast("long").alias("n_reads"), distinct_of(r, lambda x: x.evidence_group).alias("n_groups"), F.when(some, array_texts(r, trusted)).alias("texts"),
    )


def session_votes(reads: DataFrame, keys: Sequence[str], length: int) -> DataFrame:
    """A18 as rows: weight, reads, distinct variants and evidence groups per (session, position, character)."""
    keys = list(keys)
    whole, large = place_by_session(reads, keys)
    rows = session_rows(whole, keys, length).filter(F.size("_reads") > 0)
    rows = rows.select(*keys, F.explode(array_votes(F.col("_reads"), length)).alias("_p")).select(*keys, "_p.pos", F.inline("_p.cells")).drop("neg")
    return rows if large is None else rows.unionByName(position_votes(merge_reads(large, keys, length), keys))


def votes_of_large(cells: DataFrame, every: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same without ``texts`` for sessions whose reads are merged first."""
    votes = position_votes(cells, keys)
    # at most one entry per alphabet character, then one per position
    one = F.collect_list(F.struct((-F.round("weight", 9)).alias("neg"), "seq", "char", "weight", "reads", "variants", "groups"))
    per = votes.groupBy(*keys, "pos").agg(F.array_sort(one).alias("cells"))
    rows = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "cells"))).alias("positions"))
    return null_safe_join(every, null_safe_join(rows, weighted_confidence(cells, keys), keys), keys, "left")


def choose_positions(positions: Column, sets: Column, p: FusionParams) -> Column:
    """For one model's rule sets the best character of every position, its share, margin and provenance."""

    def forced(s: Column) -> Column:
        return lookup(s.pos, p.constants) if p.constants else F.lit(None).cast("string")

    def moved(s: Column, cell: Column) -> Column:
        same = lambda f: F.array(F.struct(cell.char.alias("to"), (cell.weight * f).alias("ev"), cell.seq.alias("seq")))
        spread = lambda to: F.when(to.isNull(), same(0.5)).otherwise(F.transform(to, lambda m: F.struct(m.to.alias("to"), (cell.weight * m.share).alias("ev"), cell.seq.alias("seq"))))
        return F.when(F.array_contains(s.allowed, cell.char), same(1.0)).otherwise(bound(F.try_element_at(s.moves, cell.char), spread))

    def evidence(s: Column, cells: Column) -> Column:
        rated = lambda ev, seq, ch: F.struct((-F.round(ev, 9)).alias("neg"), seq.alias("seq"), ch.alias("char"), F.array_contains(s.allowed, ch).alias("ok"))

        def of(flow: Column, ch: Column) -> Column:
            own = F.aggregate(flow, F.lit(0.0), lambda a, f: F.when(f.to == ch, a + f.ev).otherwise(a))
            return rated(own, F.array_min(F.transform(F.filter(flow, lambda f: f.to == ch), lambda f: f.seq)), ch)

        def met(flow: Column) -> Column:
            return F.sort_array(F.transform(F.array_distinct(F.transform(flow, lambda f: f.to)), lambda ch: of(flow, ch)))

        # what one character gives goes to different ones, and allowed characters keep theirs and their order
        one = F.sort_array(F.transform(moved(s, F.get(cells, F.lit(0))), lambda f: rated(f.ev, f.seq, f.to)))
        kept = F.transform(cells, lambda c: F.struct(c.neg.alias("neg"), c.seq.alias("seq"), c.char.alias("char"), F.lit(True).alias("ok")))
        several = F.when(F.forall(cells, lambda c: F.array_contains(s.allowed, c.char)), kept).otherwise(bound(F.flatten(F.transform(cells, lambda c: moved(s, c))), met))
        return F.when(F.size(cells) == 1, one).otherwise(several)

    def decision(s: Column, cells: Column, ev: Column, x: Column) -> Column:
        prob = F.coalesce(-F.try_element_at(F.filter(ev, lambda e: e.char == x.chosen), F.lit(1)).neg, F.lit(0.0)) / x.total
        rivals = F.filter(ev, lambda e: (e.char != x.chosen) & (e.ok | ~x.fits))
        second = F.coalesce(-F.try_element_at(rivals, F.lit(1)).neg, F.lit(0.0)) / x.total
        seen, raw, zero = x.cell.isNotNull(), F.element_at(cells, 1).char, F.lit(0).cast("long")
        corrected = (x.chosen != raw) & (~seen | (x.forced.isNotNull() & (x.forced != raw)))
        others = F.transform(F.filter(cells, lambda c: c.char != x.chosen), lambda c: c.char)
        return bound(prob, lambda prob: F.struct(
            s.pos.alias("pos"), raw.alias("raw_char"), x.chosen.alias("chosen"), x.fits.alias("allowed"), prob.alias("prob"), F.greatest(F.lit(0.0), prob - second).alias("margin"),
            F.coalesce(x.cell.reads, zero).alias("support"), F.coalesce(x.cell.groups, zero).alias("groups"), F.coalesce(x.cell.variants, zero).alias("variants"),
            corrected.alias("structure_corrected"), x.forced.isNotNull().alias("forced"), seen.alias("seen"), others.alias("others"),
        ))

    def contested(s: Column, cells: Column) -> Column:
        def chosen(ev: Column, forced: Column, best: Column) -> Column:
            total = F.aggregate(ev, F.lit(0.0), lambda a, e: a - e.neg)
            cell = F.try_element_at(F.filter(cells, lambda c: c.char == best), F.lit(1))
            return F.struct(forced.alias("forced"), best.alias("chosen"), F.array_contains(s.allowed, best).alias("fits"), total.alias("total"), cell.alias("cell"))

        def choose(ev: Column) -> Column:
            return bound(F.coalesce(forced(s), F.element_at(ev, 1).char), lambda best: bound(chosen(ev, forced(s), best), lambda x: decision(s, cells, ev, x)))

        return bound(evidence(s, cells), choose)

    def agreed(s: Column, cell: Column) -> Column:
        """The only character seen is allowed and not overruled: it keeps all evidence and has no rival."""
        prob, none = cell.neg / cell.neg, F.lit(False)
        return F.struct(
            s.pos.alias("pos"), cell.char.alias("raw_char"), cell.char.alias("chosen"), F.lit(True).alias("allowed"), prob.alias("prob"), F.greatest(F.lit(0.0), prob).alias("margin"),
            cell.reads.alias("support"), cell.groups.alias("groups"), cell.variants.alias("variants"),
            none.alias("structure_corrected"), forced(s).isNotNull().alias("forced"), F.lit(True).alias("seen"), F.array().cast("array<string>").alias("others"),
        )

    def choice(s: Column, cells: Column, first: Column) -> Column:
        alone = (F.size(cells) == 1) & F.array_contains(s.allowed, first.char) & (forced(s).isNull() | (forced(s) == first.char))
        return F.when(alone, agreed(s, first)).otherwise(contested(s, cells))

    return F.transform(sets, lambda s: bound(F.get(positions, s.pos - 1).cells, lambda cells: bound(F.get(cells, F.lit(0)), lambda first: choice(s, cells, first))))


def best_model(models: Column, sets: Column, positions: Column, avg_conf: Column, p: FusionParams) -> Column:
    """Best model of a session by (fully valid, score); an earlier model wins ties. NULL without rules or votes.

    Models have the numbers of their rule sets in ``at``: what several of them share is chosen once.
    """
    rank = lambda m: lookup(m, {n: -i for i, n in enumerate(p.models)}) if p.models else F.lit(0)
    size = F.lit(float(p.length))

    def rated(m: Column, every: Column) -> Column:
        compliance = F.size(F.filter(m.at, lambda i: F.get(every, i).allowed)) / size
        mean_prob = F.aggregate(m.at, F.lit(0.0), lambda a, i: a + F.get(every, i).prob) / size
        return bound(F.struct(compliance.alias("compliance"), mean_prob.alias("mean_prob")), lambda q: bound(0.5 * q.compliance + 0.25 * q.mean_prob + 0.25 * avg_conf, lambda score: F.struct(
            (q.compliance == 1.0).alias("fully"), F.round(score, 9).alias("_s"), rank(m.model).alias("_r"), m.model.alias("model"), score.alias("score"),
            q.compliance.alias("compliance"), q.mean_prob.alias("mean_prob"), m.at.alias("at"),
        )))

    def whole(best: Column, every: Column) -> Column:
        decisions = F.transform(best.at, lambda i: F.get(every, i))
        fused = F.array_join(F.transform(best.at, lambda i: F.get(every, i).chosen), "")
        return F.when(best.isNotNull(), F.struct(*[best[n].alias(n) for n in ("fully", "model", "score", "compliance", "mean_prob")], fused.alias("fused"), decisions.alias("decisions")))

    used = F.filter(models, lambda m: F.size(m.at) > 0)
    chosen = lambda every: bound(F.array_max(F.transform(used, lambda m: rated(m, every))), lambda best: whole(best, every))
    return F.when(positions.isNotNull(), bound(choose_positions(positions, sets, p), chosen))


def array_evidence(texts: Column, fused: Column, final_model: Column, sets: Column, p: FusionParams) -> Column:
    """A21 on the texts of one session: support for the fused text by reads that equal it, and strictly valid rivals of the same model."""
    mine = F.try_element_at(F.filter(texts, lambda t: t.text == fused), F.lit(1))
    text_model = lambda t: lookup(F.substring(t, 1, p.prefix_width), p.prefixes) if p.prefixes else final_model
    valid = lambda t: F.coalesce(F.forall(sets, lambda s: F.array_contains(s.allowed, F.substr(t, s.pos, F.lit(1)))), F.lit(False)) & text_model(t).eqNullSafe(final_model)
    rival = F.array_max(F.transform(F.filter(texts, lambda t: (t.text != fused) & (t.trusted > 0) & valid(t.text)), lambda t: t.weight))
    zero = F.lit(0).cast("long")
    return F.struct(
        F.coalesce(mine.reads, zero).alias("exact_reads"), F.coalesce(mine.groups, zero).alias("exact_groups"), F.coalesce(mine.trusted, zero).alias("trusted_bases"),
        F.coalesce(F.round(mine.conf / mine.reads, 3), F.lit(0.0)).alias("exact_mean_conf"),
        F.coalesce(rival / F.greatest(F.coalesce(mine.weight, F.lit(0.0)), F.lit(1e-9)) >= p.conflict_ratio, F.lit(False)).alias("conflict"),
    )


def exact_evidence(cells: DataFrame, fused: DataFrame, keys: Sequence[str], grammar: DataFrame, p: FusionParams) -> DataFrame:
    """Support for the fused text by reads that equal it, and strictly valid rivals of the same model.
    Added to the columns of ``fused``, which is read only once."""
    base = base_variant(F.col("variant_name"))
    trusted = F.when(base.isin(list(p.trusted_variants)), base) if p.trusted_variants else F.lit(None).cast("string")
    texts = cells.groupBy(*keys, "text").agg(
        F.sum("weight").alias("t_weight"), F.sum("reads").alias("t_reads"), F.sum("conf_sum").alias("t_conf"),
        F.count_distinct("evidence_group").alias("t_groups"), F.count_distinct(trusted).alias("t_trusted"),
    )
    t = null_safe_join(texts, fused, keys)
    same = F.col("text") == F.col("fused")
    text_model = lookup(F.substring("text", 1, p.prefix_width), p.prefixes) if p.prefixes else F.col("final_model")
    t = t.join(rule_side(grammar), t["final_model"] == grammar["_gm"], "left")
    valid = F.coalesce(F.forall("_sets", lambda s: F.array_contains(s.allowed, F.substr(F.col("text"), s.pos, F.lit(1)))), F.lit(False))
    t = t.withColumns({"_same": same, "_valid": valid & text_model.eqNullSafe(F.col("final_model"))})
    mine = F.sum(F.when(F.col("_same"), F.col("t_weight")))
    rival = F.max(F.when(~F.col("_same") & F.col("_valid") & (F.col("t_trusted") > 0), F.col("t_weight")))
    zero = F.lit(0).cast("long")
    pick = lambda c: F.coalesce(F.max(F.when(F.col("_same"), F.col(c))), zero)
    own = [c for c in fused.columns if c not in keys]
    out = t.groupBy(*keys).agg(
        F.any_value(F.struct(*own)).alias("_own"),
        pick("t_reads").alias("exact_reads"), pick("t_groups").alias("exact_groups"), pick("t_trusted").alias("trusted_bases"),
        F.coalesce(F.round(F.max(F.when(F.col("_same"), F.col("t_conf") / F.col("t_reads"))), 3), F.lit(0.0)).alias("exact_mean_conf"),
        F.coalesce(rival / F.greatest(F.coalesce(mine, F.lit(0.0)), F.lit(1e-9)) >= p.conflict_ratio, F.lit(False)).alias("conflict"),
    )
    return out.select(*keys, "_own.*", *[c for c in out.columns if c not in keys and c != "_own"])


GATES = ["final_score", "crops_or_consensus", "structurally_valid", "risky_margin", "variable_margin", "serial_margin", "exact_conflict", "raw_support_ratio", "known_model", "key_position"]
SOFT = ["risky_margin", "variable_margin", "key_position"]


def fuse_reads(reads: DataFrame, rules: DataFrame, confusions: DataFrame, p: FusionParams, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """H3: one row per session with status ACCEPT, OCR_AMBIGUOUS or NO_READ, gates and failing reasons."""
    keys = list(keys)
    whole, large = place_by_session(reads, keys)
    table = rule_positions(rules, confusions, p.confusion_prior)
    # one row: the different rule sets, and every model with its grammar and its sets' numbers
    models = table.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("pos", "allowed", "moves"))).alias("_all")).agg(F.collect_list(F.struct("model", "_all")).alias("_m"))
    models = models.withColumn("_u", F.array_distinct(F.filter(F.flatten(F.transform("_m", lambda m: m["_all"])), lambda s: (s.pos >= 1) & (s.pos <= p.length))))
    at = lambda m: F.filter(F.transform(m["_all"], lambda s: (F.array_position("_u", s) - 1).cast("int")), lambda i: i >= 0)
    models = F.broadcast(models.select(
        F.transform("_m", lambda m: F.struct(m.model.alias("model"), F.transform(m["_all"], lambda s: F.struct(s.pos.alias("pos"), s.allowed.alias("allowed"))).alias("sets"), at(m).alias("at"))).alias("_models"),
        F.transform("_u", lambda s: F.struct(s.pos.alias("pos"), s.allowed.alias("allowed"), F.map_from_entries(s.moves).alias("moves"))).alias("_sets"),
    ))
    labelled = lookup(F.substring("fused", 1, p.prefix_width), p.prefixes) if p.prefixes else F.lit(None).cast("string")

    def chosen(rows: DataFrame) -> DataFrame:
        rated = once(rows.crossJoin(models), best_model(F.col("_models"), F.col("_sets"), F.col("positions"), F.col("avg_conf"), p), "_b")
        best = rated.drop("positions", "_sets").select("*", "_b.*").drop("_b").withColumn("final_model", F.coalesce(labelled, "model"))
        # the key position is judged by the grammar of the final model, which the prefix may have changed
        own = F.try_element_at(F.filter("_models", lambda m: m.model == F.col("final_model")), F.lit(1)).sets
        best = best.withColumn("_own_sets", own).drop("_models")
        key_set = F.try_element_at(F.filter("_own_sets", lambda s: s.pos == p.key), F.lit(1)).allowed
        return best.withColumn("_key_set", F.coalesce(key_set, F.array().cast("array<string>")))

    def with_evidence(rows: DataFrame) -> DataFrame:
        found = array_evidence(F.col("texts"), F.col("fused"), F.col("final_model"), F.col("_own_sets"), p)
        return once(chosen(rows), found, "_e").drop("texts", "_own_sets").select("*", "_e.*").drop("_e")

    out = decide(with_evidence(votes_per_session(whole, keys, p.length, p.trusted_variants)), keys, p)
    if large is None:
        return out
    cells = merge_reads(large, keys, p.length)
    rows = chosen(votes_of_large(cells, large.select(*keys).distinct(), keys)).drop("_own_sets")
    grammar = table.groupBy(F.col("model").alias("_gm")).agg(F.collect_list(F.struct("pos", "allowed")).alias("_sets"))
    evidence = exact_evidence(cells, rows.filter("fused is not null"), keys, grammar, p)
    return out.unionByName(decide(evidence.unionByName(rows.filter("fused is null"), allowMissingColumns=True), keys, p))


def decide(j: DataFrame, keys: list[str], p: FusionParams) -> DataFrame:
    """Gates, rescues and status of sessions with their choice and evidence."""
    ds = F.col("decisions")
    lowest = lambda keep: F.coalesce(F.array_min(F.transform(F.filter(ds, keep), lambda x: x.margin)), F.lit(1.0))
    at = lambda positions: F.array(*[F.lit(i) for i in positions]) if positions else F.array().cast("array<int>")
    j = j.withColumns(
        {
            "m_risky": lowest(lambda x: F.array_contains(at(p.risky), x.pos) & ~x.forced),
            "m_variable": lowest(lambda x: ~x.forced),
            "m_serial": lowest(lambda x: F.array_contains(at(p.serial), x.pos)),
            "raw_support": F.size(F.filter(ds, lambda x: (x.support > 0) | x.forced)) / F.lit(float(p.length)),
            "_corr": F.exists(ds, lambda x: x.structure_corrected & ~x.forced),
            "k": F.element_at(ds, p.key),
        }
    )
    k = F.col("k")
    structural = ~k.seen | k.structure_corrected
    suspect = F.contains(F.lit(p.suspects), k.raw_char) if p.suspects else F.lit(False)
    backed = (k.groups >= p.key_groups) | (k.variants >= p.key_variants)
    key_ok = k.allowed & (k.margin >= p.key_margin) & (~structural | (backed & ~suspect))
    j = j.withColumn("_key_ok", key_ok)
    single = F.lit(p.single_read) & F.col("fully") & (F.col("score") >= p.single_score) & ~F.col("_corr") & F.col("_key_ok") & (F.col("m_risky") >= p.risky_margin) & (F.col("raw_support") >= 0.999)
    consensus = (F.col("n_groups") >= p.min_groups) | ((F.col("n_reads") >= p.multi_variant) & (F.col("mean_prob") >= p.strong_prob)) | single
    gates = {
        "final_score": (F.col("score") >= p.final_score, F.col("score"), p.final_score),
        "crops_or_consensus": (consensus, F.col("n_groups"), p.min_groups),
        "structurally_valid": (F.col("fully"), F.col("compliance"), 1.0),
        "risky_margin": (F.col("m_risky") >= p.risky_margin, F.col("m_risky"), p.risky_margin),
        "variable_margin": (F.col("m_variable") >= p.variable_margin, F.col("m_variable"), p.variable_margin),
        "serial_margin": (F.col("m_serial") >= p.serial_margin, F.col("m_serial"), p.serial_margin),
        "exact_conflict": (~F.col("conflict"), F.col("conflict").cast("double"), 0.0),
        "raw_support_ratio": (F.col("raw_support") >= p.raw_support, F.col("raw_support"), p.raw_support),
        "known_model": (F.col("final_model").isNotNull() | F.lit(not p.require_known), F.col("final_model").isNotNull().cast("double"), 1.0),
        "key_position": (F.col("_key_ok"), k.margin, p.key_margin),
    }
    failed = F.filter(F.array(*[F.when(~gates[g][0], F.lit(g)) for g in GATES]), lambda x: x.isNotNull())
    j = j.withColumn("failed", failed)
    soft = F.array(*[F.lit(s) for s in SOFT])
    rescuable = (F.size("failed") > 0) & (F.size(F.array_except("failed", soft)) == 0)
    backed_exactly = (F.col("exact_mean_conf") >= p.rescue_conf) & ((F.col("exact_groups") >= 2) | (F.col("trusted_bases") >= 2)) & ~F.col("conflict")
    rival_seen = F.exists(k.others, lambda ch: F.array_contains("_key_set", ch))
    rescue_a = rescuable & F.col("fully") & k.seen & ~rival_seen & backed_exactly
    in_list = F.contains(F.lit(p.rescue_raw), k.raw_char) if p.rescue_raw else F.lit(False)
    rescue_b = (
        F.lit(p.rescue_b) & ~rescue_a & rescuable & F.array_contains("failed", "key_position") & F.col("fully") & structural & F.array_contains("_key_set", k.chosen) & in_list
        & (F.col("score") >= p.rescue_b_score) & (F.col("raw_support") >= p.rescue_b_support) & backed_exactly
    )
    j = j.withColumn("rescue", F.when(rescue_a, "DIRECT").when(rescue_b, "STRUCTURE"))
    j = j.withColumn("reasons", F.when(F.col("rescue").isNotNull(), F.array().cast("array<string>")).otherwise(F.col("failed")))
    gate_map = F.map_from_arrays(
        F.array(*[F.lit(g) for g in GATES]),
        F.array(*[F.struct((~F.array_contains("reasons", g)).alias("passed"), gates[g][1].cast("double").alias("value"), F.lit(float(gates[g][2])).alias("threshold")) for g in GATES]),
    )
    row = F.struct(
        F.when(F.size("reasons") == 0, "ACCEPT").otherwise("OCR_AMBIGUOUS").alias("status"), F.col("fused"), F.col("final_model").alias("model"),
        "score", "compliance", "fully", F.col("raw_support").alias("raw_support_ratio"), "mean_prob", "avg_conf", "n_reads", "n_groups",
        "exact_reads", "exact_groups", "trusted_bases", "exact_mean_conf", "conflict", "decisions", gate_map.alias("gates"), "rescue", "reasons",
    )
    out = once(j, F.when(F.col("fused").isNotNull(), row), "_o").select(*keys, "_o.*")
    return out.withColumn("status", F.coalesce("status", F.lit("NO_READ"))).withColumn("fused", F.coalesce("fused", F.lit("")))


def unresolved(fused: DataFrame) -> DataFrame:
    """sessions that need the second pass: not accepted, or accepted on thin or contested evidence."""
    settled = (F.col("status") == "ACCEPT") & (F.col("exact_groups") >= 2) & ~F.col("conflict")
    return fused.filter(~F.coalesce(settled, F.lit(False)))


def rerank_table(rules: DataFrame, confusions: DataFrame, p: FusionParams, bonus: float, penalty: float) -> DataFrame:
    """One row per model: per position its characters as one text, in that order the candidates of each, and what a character without an entry becomes."""
    table = rule_positions(rules, confusions, p.confusion_prior)
    grammar = table.groupBy(F.col("model").alias("_gm")).agg(F.sort_array(F.collect_list(F.struct("pos", "allowed"))).alias("_rules"))
    near = confusions.groupBy("char").agg(F.sort_array(F.collect_list(F.struct("rank", "alt"))).alias("near"))
    near = near.agg(F.map_from_entries(F.collect_list(F.struct("char", F.transform("near", lambda n: n.alt).alias("alts")))).alias("_near"))

    def entry(s: Column) -> Column:
        forced = lookup(s.pos, p.constants) if p.constants else F.lit(None).cast("string")
        inside = lambda x: F.array_contains(s.allowed, x)

        def candidate(ch: Column, x: Column, i: Column) -> Column:
            final = F.coalesce(forced, x)
            changed = (final != ch) & (forced.isNotNull() | (inside(final) & ~inside(ch)))
            pick = F.struct(final.alias("char"), inside(final).alias("ok"), changed.alias("changed"))
            return F.struct(F.when(inside(x), F.lit(bonus)).otherwise(F.lit(-penalty)).alias("extra"), (-i).alias("first"), pick.alias("pick"))

        chars = F.filter(F.array_distinct(F.concat(s.allowed, F.map_keys("_near"))), lambda ch: F.length(ch) == 1)
        alts = lambda ch: F.coalesce(F.try_element_at(F.col("_near"), ch), F.array().cast("array<string>"))
        choices = F.transform(chars, lambda ch: F.transform(F.concat(F.array(ch), alts(ch)), lambda x, i: candidate(ch, x, i)))
        return F.struct(s.pos.alias("pos"), F.array_join(chars, "").alias("chars"), choices.alias("choices"), forced.alias("forced"), F.coalesce(inside(forced), F.lit(False)).alias("forced_ok"))

    return grammar.crossJoin(F.broadcast(near)).select("_gm", F.transform("_rules", entry).alias("_sets"))  # ``near`` is one row


def rerank_reads(reads: DataFrame, rules: DataFrame, confusions: DataFrame, p: FusionParams, id_cols: Sequence[str], visual_weight: float = 1.0, bonus: float = 0.5, penalty: float = 0.5, alt_prior: float = 0.6) -> DataFrame:
    """Re-rank one read per row. Candidates are the character and its neighbours; the grammar adds
    a bonus or a penalty; constant positions are overwritten. Columns: text, model, confs (array<double>).

    What does not depend on the confidences is decided once per model, position and character.
    """
    # a model is one key: dealt out by it, all reads of a model would meet in one task
    j = reads.join(rule_side(rerank_table(rules, confusions, p, bonus, penalty)), F.col("model") == F.col("_gm"), "left")

    def decide(s: Column) -> Column:
        ch = F.substr(F.col("text"), s.pos, F.lit(1))
        visual = F.get("confs", s.pos - 1)

        def rated(x: Column) -> Column:
            seen = F.when(x["first"] == 0, visual).otherwise(visual * alt_prior)
            return F.struct((visual_weight * seen + x.extra).alias("score"), x["first"].alias("first"), seen.alias("visual"), x.pick.alias("pick"))

        # only a character with neighbours has something to compare
        only = lambda pick: F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("first"), visual.alias("visual"), pick.alias("pick"))
        new = F.struct(F.coalesce(s.forced, ch).alias("char"), s.forced_ok.alias("ok"), F.coalesce(s.forced != ch, F.lit(False)).alias("changed"))
        best = lambda known: F.when(F.size(known) == 1, only(F.get(known, F.lit(0)).pick)).when(F.size(known) > 1, F.array_max(F.transform(known, rated))).otherwise(only(new))
        # the empty text is in every text
        place = F.when(ch != "", F.instr(s.chars, ch))
        return F.get(F.transform(F.array(F.get(s.choices, place - 1)), best), F.lit(0))

    j = once(j, F.when(F.length("text") == p.length, F.transform("_sets", decide)), "_d")
    usable = F.col("_d").isNotNull()
    overall = F.aggregate("confs", F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size("confs"), F.lit(1))
    comp = F.size(F.filter("_d", lambda x: x.pick.ok)) / F.lit(float(p.length))
    mean = F.aggregate("_d", F.lit(0.0), lambda a, x: a + x.visual) / F.lit(float(p.length))
    return j.select(
        *id_cols,
        F.when(usable, F.array_join(F.transform("_d", lambda x: x.pick.char), "")).otherwise(F.col("text")).alias("final_text"),
        F.when(usable, 0.5 * mean + 0.5 * comp).otherwise(overall).alias("score"),
        F.when(usable, comp).otherwise(0.0).alias("compliance"),
        F.when(usable, F.exists("_d", lambda x: x.pick.changed)).otherwise(False).alias("structure_corrected"),
    )


__all__ = [n for n in dir() if not n.startswith("_")]
