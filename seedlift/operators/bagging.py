"""Positive-unlabelled bagging: balanced blocks, folds, and their membership table.

All draws are md5 orders, so every row's block and fold follows from its position
by arithmetic; nothing but that one ordering is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedlift.functions.numbers import half_even
from seedlift.operators.order import shuffled_positions


@dataclass(frozen=True)
class BlockPlan:
    """Sizes of a balanced partition of `unlabelled` rows around `seeds` seeds."""

    seeds: int
    unlabelled: int
    ratio: float
    seed_ratio: float = 1.0

    def __post_init__(self):
        if not 0 < self.take <= self.unlabelled:
            raise ValueError(f"cannot draw blocks of {self.take} from {self.unlabelled} unlabelled rows")

    @property
    def used(self) -> int:
        """Seeds in each block."""
        return half_even(self.seeds * self.seed_ratio)

    @property
    def take(self) -> int:
        """Unlabelled rows in each block before leftovers."""
        return half_even(self.used * self.ratio)

    @property
    def blocks(self) -> int:
        return self.unlabelled // self.take

    @property
    def left(self) -> int:
        return self.unlabelled - self.blocks * self.take

    @property
    def chunk(self) -> int:
        """Leftover rows dealt to one block."""
        return half_even(self.left / self.blocks) + 1

    @property
    def full_chunks(self) -> int:
        return max(-(-self.left // self.chunk) - 1, 0)

    @property
    def rows(self) -> int:
        return self.used * self.blocks + self.unlabelled

    def place(self, rn: Column) -> tuple[Column, Column]:
        """(block, 1-based position in the block) of the unlabelled row at 1-based `rn`."""
        n, m = self.take, self.full_chunks
        j = rn - F.lit(self.blocks * n + 1)
        into = F.floor(j / self.chunk)
        if m == 0:
            late, nth = F.lit(self.blocks - 1), j + n + 1
        else:
            late = F.least(into, F.lit(m - 1))
            nth = j - late * self.chunk + n + 1
        early = rn <= self.blocks * n
        block = F.when(early, F.floor((rn - 1) / n)).otherwise(late)
        spot = F.when(early, (rn - 1) % n + 1).otherwise(nth)
        return block.cast("int"), spot.cast("bigint")

    def block_size(self, block: Column) -> Column:
        """Unlabelled rows of a block, leftovers included."""
        n, m = self.take, self.full_chunks
        if m == 0:
            return F.when(block == self.blocks - 1, n + self.left).otherwise(n).cast("bigint")
        last = self.left - (m - 1) * self.chunk
        return (F.when(block < m - 1, n + self.chunk).when(block == m - 1, n + last).otherwise(n)).cast("bigint")


def plan_blocks(entities: DataFrame, ratio: float = 1.5, seed_ratio: float = 1.0) -> BlockPlan:
    counts = entities.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("u")).first()
    return BlockPlan(counts["p"], counts["u"], ratio, seed_ratio)


def contiguous_fold(position: Column, size: Column, k: int) -> Column:
    """Fold of a row when `size` rows are cut into k runs, the first `size % k` one longer."""
    short = F.floor(size / k)
    longer = size % k
    cut = longer * (short + 1)
    late = longer + F.floor(F.try_divide(position - 1 - cut, short))
    return F.when(position <= cut, F.floor((position - 1) / (short + 1))).otherwise(late).cast("int")


def pu_membership(
    entities: DataFrame,
    iterations: int = 10,
    ratio: float = 1.5,
    k: int = 10,
    seed_ratio: float = 1.0,
    salt: str = "pu",
    plan: BlockPlan | None = None,
) -> DataFrame:
    """`(iter, block, fold, entity_id, label)`: each unlabelled row once per iteration, seeds in every block."""
    plan = plan or plan_blocks(entities, ratio, seed_ratio)
    runs = entities.select("entity_id", "label", F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("iter"))

    others = shuffled_positions(runs.filter(F.col("label") == 0), "entity_id", salt, ["iter"])
    block, spot = plan.place(F.col("rn"))
    others = others.withColumn("block", block).withColumn("_pos", spot)
    others = others.withColumn("fold", contiguous_fold(F.col("_pos"), plan.block_size(F.col("block")), k))

    copies = runs.filter(F.col("label") == 1).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(plan.blocks - 1))))
    seeds = shuffled_positions(copies, "entity_id", salt, ["iter", "block"])
    seeds = seeds.filter(F.col("rn") <= plan.used)
    seeds = seeds.withColumn("fold", contiguous_fold(F.col("rn"), F.lit(plan.used).cast("bigint"), k))

    columns = ["iter", "block", "fold", "entity_id", "label"]
    return others.select(*columns).unionByName(seeds.select(*columns))


def check_conserved(membership: DataFrame, plan: BlockPlan, iterations: int) -> DataFrame:
    """Return `membership`, or raise if rows were lost or doubled."""
    rows = membership.count()
    if rows != plan.rows * iterations:
        raise ValueError(f"{rows} membership rows, expected {plan.rows * iterations}")
    return membership


def random_draws(membership: DataFrame, draws: int, test_size: float, salt: str = "draw") -> DataFrame:
    """Repeated stratified splits: `(iter, block, draw, entity_id, label, is_test)` for every draw."""
    rows = membership.select("iter", "block", "entity_id", "label",
                             F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    placed = shuffled_positions(rows, "entity_id", salt, ["iter", "block", "draw", "label"],
                                ["iter", "block", "draw"], "_rn", "_n")
    test = F.col("_rn") <= F.floor(F.col("_n") * F.lit(float(test_size)))
    return placed.withColumn("is_test", test.cast("int")).drop("_rn", "_n")


def sample_blocks(membership: DataFrame, blocks: int, salt: str = "eval") -> DataFrame:
    """A fixed evaluation sample: the membership rows of `blocks` random blocks."""
    keys = membership.select("iter", "block").distinct()
    chosen = keys.orderBy(F.md5(F.concat_ws(":", F.lit(salt), "iter", "block")), "iter", "block").limit(blocks)
    return membership.join(chosen, ["iter", "block"], "left_semi")
