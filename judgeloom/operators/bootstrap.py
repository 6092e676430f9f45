"""Paired bootstrap intervals of an accuracy difference: three generators of replicates.

``portable`` draws by integer arithmetic from counts, so that any SQL engine repeats it; ``multinomial`` draws the three counts
that a replicate's mean depends on, in time that doesn't grow with the pairs; ``seeded`` repeats NumPy's legacy generator on
ordered pairs, many tasks reading one stream of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from . import twister

#: Numbers of the generator that a stretch of ``seeded`` is a multiple of, and that are looked at together.
STRIDE, SLICE = 1 << 24, 1 << 17
#: Replicates that one row of the plan draws.
BLOCK = 50
#: The generator of ``portable``: a replicate's positions are (rep * STEP + i * TURN * (rep + 7) + START) % MODULUS % n.
STEP, TURN, START, MODULUS = 1103515245, 12345, 1013904223, 2147483647
#: Pairs of a group up to which positions are drawn one by one; beyond, they are counted in whole residue ranges, of which there are the fewer the more pairs there are.
DRAWN = 650_000


def drawn_sum(rep: int, n: int, n01: int, n10: int) -> int:
    """The sum of a replicate's differences, position by position."""
    import numpy as np

    first, turn, out = rep * STEP + START, TURN * (rep + 7), 0
    for low in range(0, n, 1 << 16):
        x = np.arange(low, min(n, low + (1 << 16)), dtype=np.int64) * turn + first
        x -= x // MODULUS * MODULUS
        x -= x // n * n
        out += int(np.count_nonzero(x >= n - n01)) - int(np.count_nonzero(x < n10))
    return out


def counted_sum(rep: int, n: int, n01: int, n10: int) -> int:
    """The same sum without drawing: positions are an arithmetic progression modulo MODULUS, so how many of them fall into a range is a difference of sums of floors, which
    Euclid's algorithm has in logarithmic time. A difference of 1 or -1 is a range in each of the MODULUS / n stretches of residues."""
    import numpy as np

    first, turn = (rep * STEP + START) % MODULUS, TURN * (rep + 7) % MODULUS
    base = np.arange(0, MODULUS, n, dtype=np.int64)
    ends = (base + n, base + (n - n01), base + n10, base)
    floors = _floor_sums(n, MODULUS, turn, np.concatenate([first + MODULUS - np.minimum(e, MODULUS) for e in ends])).reshape(4, -1)
    # positions below an end are a constant less its floors
    return int((floors[1] - floors[0] - floors[3] + floors[2]).sum())


def _floor_sums(n: int, m: int, a: int, b):
    """sum of (a * i + b) // m over i in 0..n-1 for every b."""
    import numpy as np

    n, out = np.full(len(b), n, np.int64), np.zeros(len(b), np.int64)
    while True:
        out += n * (n - 1) // 2 * (a // m)
        a %= m
        over = b // m
        out += n * over
        b = b - over * m
        most = a * n + b
        n = most // m
        if not n.any():
            return out
        b = most - n * m
        m, a = a, m


def portable(counts: DataFrame, by: list[str], replicates: int = 10_000, ci: float = 0.95, drawn: int = DRAWN) -> DataFrame:
    """counts: groups with n, n01, n10. A replicate draws n positions of the group's differences in order (-1, 0, 1): what is drawn follows from the place alone, so no pair is joined.

    A replicate takes time with n up to drawn pairs and with MODULUS / n beyond, so a group's time is bounded whatever its size; the result is the same either way."""
    spark = counts.sparkSession
    types = {c: counts.schema[c].dataType.simpleString() for c in by}
    long = lambda c: F.col(c).cast("long").alias(c)
    blocks = counts.where("n > 0").select(*by, long("n"), long("n01"), long("n10")).withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"), F.lit(BLOCK).cast("long"))))

    def draw(frames):
        import pandas as pd

        for f in frames:
            for k, (n, n01, n10, low) in enumerate(zip(f["n"].tolist(), f["n01"].tolist(), f["n10"].tolist(), f["rep"].tolist(), strict=True)):
                total = drawn_sum if n <= drawn else counted_sum
                means = [total(rep, n, n01, n10) / n for rep in range(low, min(replicates, low + BLOCK))]
                yield pd.concat([f[by].iloc[[k] * len(means)].reset_index(drop=True), pd.DataFrame({"mean": means})], axis=1)

    means = blocks.repartition(4 * spark.sparkContext.defaultParallelism, *by, "rep").mapInPandas(draw, ", ".join([*(f"`{c}` {t}" for c, t in types.items()), "mean double"]))
    q = F.percentile("mean", F.array(F.lit((1 - ci) / 2), F.lit((1 + ci) / 2)))
    return means.groupBy(*by).agg(q.alias("q")).select(*by, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def multinomial(counts: DataFrame, by: list[str], replicates: int = 10_000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """counts: groups with n, n01, n10. Same distribution of replicates as drawing pairs."""
    types = {c: counts.schema[c].dataType.simpleString() for c in by}

    def draw(frames):
        import zlib

        import numpy as np

        for f in frames:
            out = f[by].copy()
            low, high = [], []
            for row in f.itertuples(index=False):
                r = row._asdict()
                if not r["n"]:
                    low.append(None), high.append(None)
                    continue
                rng = np.random.RandomState(zlib.crc32("\t".join(str(r[c]) for c in by).encode()) ^ seed)
                k = rng.multinomial(int(r["n"]), [r["n10"] / r["n"], 1 - (r["n01"] + r["n10"]) / r["n"], r["n01"] / r["n"]], size=replicates)
                a, z = np.percentile((k[:, 2] - k[:, 0]) / r["n"], [50 * (1 - ci), 50 * (1 + ci)])
                low.append(float(a)), high.append(float(z))
            yield out.assign(low=low, high=high)

    return counts.select(*by, "n", "n01", "n10").mapInPandas(draw, ", ".join([*(f"{c} {t}" for c, t in types.items()), "low double", "high double"]))


def _accepted(seed: int, sizes: list[int], low: int, high: int, steps: tuple[int, ...]) -> list[int]:
    """How many of the generator's numbers from low to high are positions below each of sizes, which have equally many bits."""
    import numpy as np

    rng, mask, out = twister.at(seed, low, steps), np.uint32((1 << (sizes[0] - 1).bit_length()) - 1), [0] * len(sizes)
    for at in range(low, high, SLICE):
        numbers = rng.randint(0, 1 << 32, min(SLICE, high - at), dtype=np.uint32)
        numbers &= mask
        out = [k + int(np.count_nonzero(numbers < n)) for k, n in zip(out, sizes, strict=True)]
    return out


def _summed(differences, n: int):
    """A function of positions: the sum of the differences there. Many are held in two bits each, which caches hold longer."""
    import numpy as np

    if n <= 1 << 22:
        return lambda picks: int(differences[picks].sum())
    fours = np.zeros(-(-n // 4) * 4, np.uint8)
    fours[:n] = differences + 1
    fours = fours.reshape(-1, 4)
    held = fours[:, 0] | fours[:, 1] << 2 | fours[:, 2] << 4 | fours[:, 3] << 6

    def look(picks):
        x = held[picks >> 2]
        x >>= ((picks & 3) << 1).astype(np.uint8)
        x &= 3
        return int(x.sum()) - len(picks)

    return look


def seeded(pairs: DataFrame, by: list[str], order: list[str], replicates: int = 10_000, ci: float = 0.95, seed: int = 42, stride: int = STRIDE) -> DataFrame:
    """pairs: is_accurate_base, is_accurate_other. The draws of NumPy's RandomState(seed), replicate after replicate, over a group's pairs in order.

    A draw takes the generator's next number below the pairs' count, so where a replicate begins follows from all draws before. A group's stream is cut into stretches, a multiple of stride numbers
    each and a few times as many as there are cores: a first pass counts the numbers that each stretch draws, a second sums the differences drawn. Its tasks hold a group's differences in two bits a pair."""
    spark = pairs.sparkSession
    hands, steps = 4 * spark.sparkContext.defaultParallelism, twister.powers(64)
    places, group = [F.col(c).asc_nulls_last() for c in order], [f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in by]
    d = F.col("is_accurate_other").cast("int") - F.col("is_accurate_base").cast("int")
    rows = written(pairs.select(*by, *order, F.coalesce(d, F.raise_error(F.lit("a pair without accuracy"))).cast("tinyint").alias("__d")), "pairs")

    def pack(frames):
        import numpy as np

        seq = 0
        for f in frames:
            for _, g in f.groupby(by, dropna=False, sort=False):
                x, seq = g["__d"].to_numpy(np.int8), seq + 1
                yield g.iloc[[0]].drop(columns="__d").assign(__seq=seq, __size=len(x), __up=[np.packbits(x > 0).tobytes()], __down=[np.packbits(x < 0).tobytes()])

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("__d").schema), "__seq long, __size long, __up binary, __down binary"])
    blocks = rows.repartitionByRange(*by, *places).sortWithinPartitions(*by, *places).mapInPandas(pack, kinds)
    of_group = Window.partitionBy(*by)
    blocks = written(blocks.select(*by, F.row_number().over(of_group.orderBy(*places, "__seq")).alias("__place"), "__size", "__up", "__down", F.sum("__size").over(of_group).alias("__n")), "blocks")

    # numbers that a stream is read for: replicates times the next power of two on average, and far more than their number varies by
    bits = F.when(F.col("__n") > 1, F.length(F.bin(F.col("__n") - 1))).otherwise(0)
    mean = F.expr("shiftleft(1L, `__bits`)") * replicates
    far = F.ceil((mean + 40 * F.sqrt(mean)) / stride)
    sizes = blocks.select("__n").distinct().withColumn("__bits", bits).groupBy("__bits").agg(F.sort_array(F.collect_list("__n")).alias("__sizes")).withColumn("__stretch", F.ceil(far / hands) * stride)
    stretches = sizes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(far * stride / F.col("__stretch")) - 1)).alias("__hand"), (far * stride).alias("__end"))

    def count(frames):
        import pandas as pd

        for f in frames:
            for hand, width, end, ns in zip(*(f[c].tolist() for c in ("__hand", "__stretch", "__end", "__sizes")), strict=True):
                ns, low = [int(n) for n in ns], hand * width
                got = _accepted(seed, ns, low, min(end, low + width), steps) if ns[0] > 1 else [replicates]  # a single pair takes no numbers
                yield pd.DataFrame({"__n": ns, "__hand": hand, "__low": low, "__accepted": got})

    counted = written(stretches.repartition(4 * hands, "__bits", "__hand").mapInPandas(count, "__n long, __hand long, __low long, __accepted long"), "stretches")
    before = Window.partitionBy("__n").orderBy("__hand").rowsBetween(Window.unboundedPreceding, -1)
    enough = F.sum("__accepted").over(Window.partitionBy("__n")) >= F.col("__n") * replicates
    starts = counted.withColumn("__before", F.coalesce(F.sum("__accepted").over(before), F.lit(0))).withColumn("__before", F.when(enough, F.col("__before")).otherwise(F.raise_error(F.lit("a stream was too short"))))

    def draw(key, f):
        import numpy as np
        import pandas as pd

        f = f.sort_values("__place")
        n, at, left, low = (int(f[c].iloc[0]) for c in ("__n", "__before", "__accepted", "__low"))
        bit = lambda c: np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=k) for b, k in zip(f[c], f["__size"], strict=True)]).view(np.int8)
        look, rng, left, out = _summed(bit("__up") - bit("__down"), n), twister.at(seed, low, steps), min(left, replicates * n - at), []
        while left > 0:
            some = min(left, n - at % n)
            out.append((at // n, sum(look(rng.randint(0, n, min(SLICE, some - k))) for k in range(0, some, SLICE))))
            at, left = at + some, left - some
        return pd.DataFrame([[*key[: len(by)], *x, n] for x in out], columns=[*by, "__rep", "__total", "__n"])

    dealt = blocks.join(starts, "__n").repartition(4 * hands, *by, "__hand")
    parts = dealt.groupBy(*by, "__hand").applyInPandas(draw, ", ".join([*group, "__rep long, __total long, __n long"]))
    means = parts.groupBy(*by, "__rep").agg((F.sum("__total") / F.first("__n")).alias("mean"))

    def ends(key, f):
        import numpy as np
        import pandas as pd

        return pd.DataFrame([[*key, *np.percentile(f["mean"].to_numpy(), [50 * (1 - ci), 50 * (1 + ci)])]], columns=[*by, "low", "high"])

    return means.groupBy(*by).applyInPandas(ends, ", ".join([*group, "low double, high double"]))
