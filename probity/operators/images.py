"""Average hashes of images and regions, and joins on their Hamming distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probity.functions.special import let
from probity.sources import materialise


def average_hash(pixels: Column) -> Column:
    """64 bits, first pixel highest: set where a pixel of an 8x8 grid is above the mean."""

    def of(p):
        mean = F.aggregate(p, F.lit(0.0), lambda s, x: s + x) / F.lit(64.0)
        return let(mean, lambda m: F.aggregate(p, F.lit(0).cast("long"), lambda h, x: F.shiftleft(h, 1).bitwiseOR(F.when(x > m, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))))

    return F.when(F.size(pixels) == 64, let(F.transform(pixels, lambda x: x.cast("double")), of))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("long")


def assessment(d: Column, threshold: int) -> Column:
    return F.when(d == 0, "IDENTICAL").when(d <= 5, "HIGH").when(d <= threshold, "MODERATE").when(d <= 2 * threshold, "LOW").otherwise("DIFFERENT")


#: Hashes that go to the workers at once, and those that one task compares with them.
BLOCK, SHARE = 2_000_000, 4096


def _near(one: DataFrame, part: DataFrame, threshold: int):
    """(a, b, distance) of each hash and those of one block that are greater numbers and within the threshold, and the broadcast that the plan needs."""
    rows = part.orderBy("h").toArrow().combine_chunks()
    kind = dict(one.dtypes)["a"]
    shared = one.sparkSession.sparkContext.broadcast((rows.column("a"), rows.column("h").to_numpy()))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        keys, block = shared.value
        for batch in batches:
            own, other, far = [], [], []
            for n, h in enumerate(batch.column("h").to_numpy(zero_copy_only=False)):
                start = np.searchsorted(block, h, "right")
                d = np.bitwise_count((block[start:] ^ h).view(np.uint64))
                close = np.flatnonzero(d <= threshold)
                own.append(np.full(len(close), n))
                other.append(start + close)
                far.append(d[close])
            at = lambda parts: pa.array(np.concatenate([np.empty(0, np.int64), *parts]).astype(np.int64))
            b = keys.take(at(other))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at(own)), b.combine_chunks() if isinstance(b, pa.ChunkedArray) else b, at(far)], ["a", "b", "distance"])

    return one.mapInArrow(run, f"a {kind}, b {kind}, distance long"), shared


def similar_images(df: DataFrame, key: str, hash_: str, threshold: int = 15, block: int = BLOCK) -> DataFrame:
    """Pairs a < b of images whose hashes are within `threshold` bits. Images of one hash are a class: its least key is paired with each of the others, and only
    it is paired with other classes.

    Different hashes are compared all with all, each pair once, in numpy where they are read: blocks of at most about `block` sorted hashes go to the workers and no
    candidate becomes a row. The work is quadratic in the number of different hashes, as any exact search at that distance, at about a nanosecond a pair. With
    several blocks each one's results are checkpointed before it is released."""
    known = df.where(F.col(hash_).isNotNull()).select(F.col(key).alias("id"), F.col(hash_).alias("h"))
    one = materialise(known.groupBy("h").agg(F.min("id").alias("a")))
    n = one.count()
    blocks, dealt = max(1, -(-n // block)), one.repartition(max(1, -(-n // SHARE)), "h")
    pairs = None
    for i in range(blocks):
        near, shared = _near(dealt, one if blocks == 1 else one.where(F.pmod(F.xxhash64("h"), F.lit(blocks)) == i), threshold)
        if blocks > 1:
            near = materialise(near)
            shared.destroy()
        pairs = near if pairs is None else pairs.unionByName(near)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")
    members = known.select(F.col("id").alias("b"), "h").join(one, "h").where("a < b").select("a", "b", F.lit(0).cast("long").alias("distance"))
    return pairs.unionByName(members).withColumn("assessment", assessment(F.col("distance"), threshold))


def _firsts(own: DataFrame, part: DataFrame, threshold: int):
    """(f, n) of the folders of some images: in how many pairs with an image of one block of them an image is the first, where the hash of the block's is
    the greater one or the same, and the broadcast that the plan needs."""
    import numpy as np

    rows = part.orderBy("h", "id").toArrow().combine_chunks()
    folders = rows.column("f").combine_chunks().dictionary_encode("encode") if len(rows) else rows.column("f")
    h = rows.column("h").to_numpy()
    starts = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
    shared = own.sparkSession.sparkContext.broadcast((h[starts], np.append(starts, len(h)), rows.column("id"), folders))

    def run(batches):
        import pyarrow as pa

        hashes, starts, ids, folders = shared.value
        if not len(hashes):
            return
        ids, codes, firsts = ids.to_numpy(), folders.indices.to_numpy(), np.zeros(len(folders.dictionary), np.int64)
        some = lambda names, n: pa.RecordBatch.from_arrays([names.take(pa.array(np.flatnonzero(n))), pa.array(n[n > 0])], ["f", "n"])
        for batch in batches:
            h, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "id"))
            n = np.zeros(len(h), np.int64)
            cuts = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1), len(h)] if len(h) else []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                x, at, after = keys[lo:hi], np.searchsorted(hashes, h[lo], "left"), np.searchsorted(hashes, h[lo], "right")
                if at < after:
                    copies = ids[starts[at] : starts[after]]
                    n[lo:hi] += len(copies) - np.searchsorted(copies, x, "right")
                near = after + np.flatnonzero(np.bitwise_count((hashes[after:] ^ h[lo]).view(np.uint64)) <= threshold)
                if len(near):
                    size = starts[near + 1] - starts[near]
                    place = np.arange(size.sum()) + np.repeat(starts[near] - np.cumsum(size) + size, size)
                    y = ids[place]
                    n[lo:hi] += len(y) - np.cumsum(np.bincount(np.searchsorted(x, y, "left"), minlength=len(x) + 1))[:-1]
                    np.add.at(firsts, codes[place], len(x) - np.searchsorted(x, y, "right"))
            mine = batch.column("f").dictionary_encode("encode")
            sums = np.zeros(len(mine.dictionary), np.int64)
            np.add.at(sums, mine.indices.to_numpy(), n)
            yield some(mine.dictionary, sums)
        yield some(folders.dictionary, firsts)

    return own.select("h", "id", "f").mapInArrow(run, f"f {dict(own.dtypes)['f']}, n long"), shared


def suspicious(images: DataFrame, by: str, key: str, hash_: str, threshold: int = 15, block: int = BLOCK) -> DataFrame:
    """(by, n_suspicious): all pairs of images whose hashes are within `threshold` bits, those of copies and with copies included, counted under the folder of
    the image with the lesser key.

    Different hashes are compared as by `similar_images`, each pair once. Copies are counted by their place among the keys of the near images, so that no pair
    becomes a row. Images are dealt by ranges of hash and key, so that neither a task nor a block takes a large class whole."""
    known = materialise(images.where(F.col(hash_).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(hash_).alias("h"), F.col(by).alias("f")))
    share = min(SHARE, block)
    parts, step = max(1, -(-known.count() // share)), block // share
    dealt = materialise(known.repartitionByRange(parts, "h", "id").sortWithinPartitions("h", "id").withColumn("part", F.spark_partition_id()))
    found = None
    for start in range(0, parts, step):
        own = dealt.where(F.col("part") < start + step).sortWithinPartitions("h", "id")
        counts, shared = _firsts(own, dealt.where(F.col("part").between(start, start + step - 1)), threshold)
        if parts > step:
            counts = materialise(counts.groupBy("f").agg(F.sum("n").alias("n")))
            shared.destroy()
        found = counts if found is None else found.unionByName(counts)
    return found.groupBy(F.col("f").alias(by)).agg(F.sum("n").alias("n_suspicious"))


def _with_pairs(images: DataFrame, found: DataFrame, by: str) -> DataFrame:
    n, found = images.groupBy(by).agg(F.count("*").alias("n_images")), found.withColumnRenamed(by, "_by")
    half = F.floor(F.col("n_images") * (F.col("n_images") - 1) / 2)
    return n.join(found, n[by].eqNullSafe(found["_by"]), "left").select(by, "n_images", half.alias("n_pairs"), F.coalesce("n_suspicious", F.lit(0).cast("long")).alias("n_suspicious"))


def totals(images: DataFrame, pairs: DataFrame, by: str, key: str) -> DataFrame:
    """Images, pairs of them and given suspicious pairs of each folder; pairs are counted under the folder of their first image. Pairs of class representatives
    count as such: `whole_totals` counts those of their copies, too."""
    return _with_pairs(images, pairs.join(images.select(F.col(key).alias("a"), by), "a").groupBy(by).agg(F.count("*").alias("n_suspicious")), by)


def whole_totals(images: DataFrame, by: str, key: str, hash_: str, threshold: int = 15) -> DataFrame:
    """Images, pairs of them and all suspicious pairs of each folder; pairs are counted under the folder of their first image."""
    return _with_pairs(images, suspicious(images, by, key, hash_, threshold), by)


def clone_report(found: DataFrame, key: str, most: int = 20) -> DataFrame:
    """The first `most` clones of each image in reading order, and how many more there are."""
    place = Window.partitionBy(key).orderBy("y1", "x1", "y2", "x2")
    ranked = found.withColumn("place", F.row_number().over(place)).withColumn("n_more", F.greatest(F.count("*").over(Window.partitionBy(key)) - most, F.lit(0).cast("long")))
    return ranked.where(F.col("place") <= most)


def decoded(files: DataFrame, size: int = 8) -> DataFrame:
    """(path, pixels, error): grey images of size x size pixels from file contents. PGM, PPM and PNG files are read here; others need Pillow on the
    workers and are named in `error` without it."""

    def run(batches):
        import pyarrow as pa

        from probity.sources.pictures import grey

        for batch in batches:
            rows = [grey(c.as_py(), size) for c in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([p for p, _ in rows], pa.list_(pa.float64())), pa.array([e for _, e in rows], pa.string())], ["path", "pixels", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, pixels array<double>, error string")


def regions(pixels: DataFrame, key: str, window: int = 32, stride: int = 16, least_sd: float = 15.0) -> DataFrame:
    """(key, x0, y0, hash) of each window that is not blank, from rows (key, width, height, x, y, v): windows, cells and bits by two aggregates."""
    cell = window // 8
    span = lambda c, size: F.filter(F.sequence(F.lit(0), F.lit(window // stride)), lambda i: ((F.floor(c / stride) - i) * stride >= 0) & (c < (F.floor(c / stride) - i) * stride + window) & ((F.floor(c / stride) - i) * stride + window <= size))
    at = pixels.select(key, "x", "y", "v", "width", "height", F.explode(span(F.col("x"), F.col("width"))).alias("i")).select(key, "x", "y", "v", "height", ((F.floor(F.col("x") / stride) - F.col("i")) * stride).alias("x0"))
    at = at.select(key, "x", "y", "v", "x0", F.explode(span(F.col("y"), F.col("height"))).alias("i")).select(key, "x", "y", "v", "x0", ((F.floor(F.col("y") / stride) - F.col("i")) * stride).alias("y0"))
    cells = at.groupBy(key, "x0", "y0", F.floor((F.col("y") - F.col("y0")) / cell).alias("r"), F.floor((F.col("x") - F.col("x0")) / cell).alias("c")).agg(F.avg("v").alias("m"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.count("*").alias("n"))
    whole = cells.groupBy(key, "x0", "y0").agg(F.array_sort(F.collect_list(F.struct("r", "c", "m"))).alias("g"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    sd = F.sqrt(F.greatest(F.col("q") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n")), F.lit(0.0)))
    return whole.where(sd >= least_sd).select(key, "x0", "y0", average_hash(F.transform("g", lambda x: x["m"])).alias("hash"))


def clones(hashed: DataFrame, key: str, window: int = 32, threshold: int = 5) -> DataFrame:
    """Pairs of regions of one image within `threshold` bits that do not overlap; distance 0 is CRITICAL."""
    a = hashed.select(key, F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.col("hash").alias("h1"))
    b = hashed.select(key, F.col("x0").alias("x2"), F.col("y0").alias("y2"), F.col("hash").alias("h2"))
    d = hamming(F.col("h1"), F.col("h2"))
    apart = (F.abs(F.col("x1") - F.col("x2")) >= window) | (F.abs(F.col("y1") - F.col("y2")) >= window)
    ordered = F.struct("y1", "x1") < F.struct(F.col("y2").alias("y1"), F.col("x2").alias("x1"))
    return a.join(b, key).where(ordered & apart & (d <= threshold)).select(key, "x1", "y1", "x2", "y2", d.alias("distance"), F.when(d == 0, "CRITICAL").otherwise("HIGH").alias("severity"))
