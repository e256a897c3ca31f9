"""The adversarial loop: genomes, row mutators, generations against a detector, write-back."""

from __future__ import annotations

import hashlib
import json
import random
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.scalars import uniform
from corvane.generators.scenarios import finalise
from corvane.operators.ordered import numbered

# The genes and the bounds of each.
GENE_BOUNDS: dict[str, tuple[float, float]] = {
    "amount_scale": (0.35, 1.80),
    "time_spread": (0.25, 6.00),
    "campaign_fanout": (1.00, 4.00),
    "merchant_spread": (0.00, 0.90),
    "device_rotate": (0.00, 0.90),
    "hour_shift": (-8.00, 8.00),
    "provenance_clean": (0.00, 0.90),
    "delegation_delta": (-1.00, 3.00),
    "deliberation_scale": (0.40, 4.00),
}
#: The value of each gene that leaves a row as it is.
NEUTRAL = {gene: 1.0 if gene in ("amount_scale", "time_spread", "campaign_fanout", "deliberation_scale") else 0.0 for gene in GENE_BOUNDS}
BOUNDS = {gene: (lo, hi, NEUTRAL[gene]) for gene, (lo, hi) in GENE_BOUNDS.items()}


@dataclass(frozen=True)
class Genome:
    card: str
    genes: tuple[float, ...]

    def __getitem__(self, name: str) -> float:
        return self.genes[list(BOUNDS).index(name)]

    def label(self) -> str:
        return hashlib.sha256(json.dumps([self.card, [round(g, 6) for g in self.genes]]).encode()).hexdigest()[:10]

    def distance(self, other: Genome) -> float:
        """Mean share of each gene's range between two genomes."""
        return sum(abs(a - b) / (hi - lo) for a, b, (lo, hi, _) in zip(self.genes, other.genes, BOUNDS.values(), strict=True)) / len(BOUNDS)


def identity(card: str) -> Genome:
    return Genome(card, tuple(x for _, _, x in BOUNDS.values()))


def _clip(v: float, lo: float, hi: float) -> float:
    return min(hi, max(lo, v))


def random_genome(card: str, rng: random.Random) -> Genome:
    return Genome(card, tuple(rng.uniform(lo, hi) for lo, hi, _ in BOUNDS.values()))


def mutate_genome(g: Genome, rng: random.Random, chance: float = 0.5, spread: float = 0.18) -> Genome:
    return Genome(g.card, tuple(_clip(v + rng.gauss(0, spread * (hi - lo)), lo, hi) if rng.random() < chance else v for v, (lo, hi, _) in zip(g.genes, BOUNDS.values(), strict=True)))


def cross(a: Genome, b: Genome, rng: random.Random) -> Genome:
    if a.card != b.card:
        raise ValueError("only genomes of one card cross")
    return Genome(a.card, tuple(x if rng.random() < 0.5 else y for x, y in zip(a.genes, b.genes, strict=True)))


def express(attack: DataFrame, background: DataFrame, g: Genome, seed: str = "loop") -> DataFrame:
    """The attack's rows as the genome would have them, ids prefixed with its label."""
    def u(stream: str):
        return uniform(f"{seed}/{g.label()}/{stream}", F.col("event_id"))

    bands = background.groupBy("mcc").agg(F.percentile("amount", 0.02).alias("lo"), F.percentile("amount", 0.995).alias("hi"))
    rows = attack.join(bands, "mcc", "left")
    scaled = F.col("amount") * g["amount_scale"]
    rows = rows.withColumn("amount", F.when(F.lit(g["amount_scale"] != 1.0), F.greatest(F.coalesce("lo", scaled), F.least(F.coalesce("hi", scaled), scaled))).otherwise(F.col("amount"))).drop("lo", "hi")
    blocks = max(1, round(g["campaign_fanout"]))
    if blocks > 1:  # sub-rings keep their parent's name in front, so that they cannot meet another campaign
        block = F.ntile(blocks).over(Window.partitionBy("attack_campaign").orderBy("ts", "event_id"))
        rows = rows.withColumn("attack_campaign", F.concat("attack_campaign", F.lit("/"), block.cast("string")))
    of = Window.partitionBy("attack_campaign")
    t = F.unix_timestamp("ts")
    rows = rows.withColumn("t", t).withColumn("mid", F.avg("t").over(of))
    moved = F.rint(F.col("mid") + (F.col("t") - F.col("mid")) * g["time_spread"] + 3600 * g["hour_shift"]).cast("long") - F.col("t")
    rows = rows.withColumn("moved", moved).withColumn("ts", F.timestamp_seconds(F.col("t") + F.col("moved"))).withColumn("ag_mandate_issued_ts", F.timestamp_seconds(F.unix_timestamp("ag_mandate_issued_ts") + F.col("moved"))).drop("t", "mid", "moved")
    span = background.agg(F.min("ts").alias("first"), F.max("ts").alias("last")).first()  # moved times stay inside the window
    if span["first"] is not None:
        rows = rows.withColumn("ts", F.greatest(F.lit(span["first"]), F.least(F.lit(span["last"]), F.col("ts"))))
    for column, gene in (("merchant_id", "merchant_spread"), ("device_id", "device_rotate")):
        if g[gene] > 0:
            pool = numbered(background.where(F.col(column).isNotNull()).select(F.col(column).alias("new")).distinct(), "new", "new", "r")
            n = pool.count()
            place = F.when(u(gene) < g[gene], F.floor(n * u(gene + "/pick"))).cast("long")
            rows = rows.withColumn("r", place).join(pool, "r", "left").withColumn(column, F.when(F.col(column).isNotNull(), F.coalesce("new", column))).drop("r", "new")
    depth = F.greatest(F.lit(1), F.least(F.lit(8), F.col("ag_delegation_depth") + round(g["delegation_delta"]))).cast("int")
    rows = rows.withColumn("ag_delegation_depth", F.when(F.col("ag_agent_id").isNotNull(), depth)).withColumn("ag_deliberation_latency_ms", F.col("ag_deliberation_latency_ms") * g["deliberation_scale"])
    # A cleaned chain keeps its length: every hop becomes a page of the row's own shop.
    own = F.concat(F.lit("https://shop."), F.lower("merchant_id"), F.lit(".test/item/0"))
    rows = rows.withColumn("ag_provenance_chain", F.when(u("clean") < g["provenance_clean"], F.transform("ag_provenance_chain", lambda x: own)).otherwise(F.col("ag_provenance_chain")))
    return finalise(rows.withColumn("event_id", F.concat(F.lit(f"{g.label()}-"), F.col("event_id"))))


@dataclass
class Individual:
    genome: Genome
    evasion: float
    payoff: float
    generation: int
    lineage: int = 0

    @property
    def fitness(self) -> float:
        return self.evasion * self.payoff


@dataclass
class Arena:
    generations: list[list[Individual]] = field(default_factory=list)

    def evasion_curve(self) -> list[float]:
        return [sum(i.evasion for i in g) / len(g) for g in self.generations if g]

    def survivors(self) -> list[Individual]:
        return self.generations[-1] if self.generations else []


def judge(variant: DataFrame, caught: DataFrame, base_amount: float) -> tuple[float, float]:
    """Share of events not caught, and undetected amount over the amount of the identity.  caught(event_id)."""
    r = variant.join(caught.select("event_id").distinct().withColumn("hit", F.lit(True)), "event_id", "left").agg(F.count("*").alias("n"), F.count_if(F.col("hit").isNull()).alias("free"), F.sum(F.when(F.col("hit").isNull(), F.col("amount")).otherwise(0)).alias("amount")).first()
    return (r["free"] / r["n"] if r["n"] else 0.0, float(r["amount"] or 0) / base_amount if base_amount else 0.0)


def evolve(background: DataFrame, attack: DataFrame, card: str, detect: Callable[[DataFrame, list[DataFrame]], DataFrame], generations: int = 3, population: int = 6, keep: int = 2, seed: int = 7) -> Arena:
    """Express, score, select and breed; ``detect(variant, seen)`` returns the events it catches, having learned from what earlier generations showed."""
    rng = random.Random(seed)
    base = float(attack.agg(F.sum("amount")).first()[0] or 0)
    genomes = [identity(card)] + [random_genome(card, rng) for _ in range(population - 1)]
    lineage: dict[str, int] = {}
    arena, seen = Arena(), []
    for number in range(generations):
        expressed = [(g, express(attack, background, g)) for g in genomes]
        people = []
        for g, rows in expressed:
            evasion, payoff = judge(rows, detect(rows, seen), base)
            people.append(Individual(g, evasion, payoff, number, lineage.get(g.label(), 0)))
        people.sort(key=lambda i: (-i.fitness, i.genome.label()))
        arena.generations.append(people)
        seen = seen + [rows for _, rows in expressed]
        elite = [i.genome for i in people[:keep]]
        for g in elite:
            lineage[g.label()] = lineage.get(g.label(), 0) + 1
        genomes = elite + [mutate_genome(cross(rng.choice(elite), rng.choice(elite), rng), rng) for _ in range(population - len(elite))]
    return arena


def is_novel(i: Individual, rounds: int = 3, moved: float = 0.2) -> bool:
    """Not the identity, chosen often enough, and some gene moved by a share of its range."""
    base = identity(i.genome.card)
    far = any(abs(a - b) >= moved * (hi - lo) for a, b, (lo, hi, _) in zip(i.genome.genes, base.genes, BOUNDS.values(), strict=True))
    return i.genome != base and i.lineage >= rounds and far


def discovered_cards(survivors: list[Individual], existing: list[str], rounds: int = 3) -> list[dict]:
    """A card for each novel survivor, with the next free number of its family."""
    taken, out = set(existing), []
    for i in survivors:
        if not is_novel(i, rounds):
            continue
        number = next(n for n in range(50, 100) if f"{i.genome.card[:2]}-{n}" not in taken)
        taken.add(card := f"{i.genome.card[:2]}-{number}")
        out.append({"id": card, "status": "discovered", "title": f"Variant of {i.genome.card}", "genes": dict(zip(BOUNDS, i.genome.genes, strict=True)), "fitness": i.fitness, **{k: v for k, v in asdict(i).items() if k in ("evasion", "payoff")}})
    return out
