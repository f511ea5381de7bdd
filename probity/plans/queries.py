"""The registered queries: operators bound to the driver's tables. (spark, sf_dir) -> DataFrame, by name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probity import sources
from probity.operators import citations, digits, distribution, images, metadata, overlap, pcurve, rules, statcheck, stylometry
from probity.plans import lines, report
from probity.streaming import digit_windows

C = F.col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reported_t(spark, sf_dir):
    """A t-test per part: mean quantity against 25, with a p that is rounded, and off for every third part."""
    g = table(spark, sf_dir, "lineitem").groupBy((C("l_partkey") % 40).alias("case_id")).agg(F.count("*").alias("n"), F.round((F.avg("l_quantity") - 25) / (F.stddev_samp("l_quantity") / F.sqrt(F.count("*"))), 2).alias("stat"))
    p = F.when(C("case_id") % 8 == 0, 0.0).when(C("case_id") % 8 == 1, 1.2).when(C("case_id") % 8 == 2, -0.1).otherwise(C("case_id") * 0.02)
    df = C("case_id") + 3
    none = F.lit(None).cast("double")
    return g.select("case_id", F.lit("t").alias("test"), (df + 1).alias("n"), df.alias("df"), none.alias("df1"), none.alias("df2"), "stat", p.alias("reported_p"), none.alias("reported_es"))


def _case(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy((C("l_partkey") % 40).alias("case_id")).agg(F.round(F.avg("l_quantity") / 5, 2).alias("stat"))
    return g


def reported_f(spark, sf_dir):
    none = F.lit(None).cast("double")
    return _case(spark, sf_dir).select("case_id", F.lit("F").alias("test"), none.cast("long").alias("n"), none.cast("long").alias("df"), F.lit(2.0).alias("df1"), (C("case_id") + 2).cast("double").alias("df2"), "stat", (C("case_id") * 0.003).alias("reported_p"), none.alias("reported_es"))


def reported_chi2(spark, sf_dir):
    none = F.lit(None).cast("double")
    return _case(spark, sf_dir).select("case_id", F.lit("chi2").alias("test"), none.cast("long").alias("n"), (C("case_id") % 6 + 1).alias("df"), none.alias("df1"), none.alias("df2"), (C("stat") * 2).alias("stat"), (C("case_id") * 0.01).alias("reported_p"), none.alias("reported_es"))


def reported_r(spark, sf_dir):
    none = F.lit(None).cast("double")
    return _case(spark, sf_dir).select("case_id", F.lit("r").alias("test"), (C("case_id") + 3).alias("n"), none.cast("long").alias("df"), none.alias("df1"), none.alias("df2"), (C("stat") / 6).alias("stat"), (C("case_id") * 0.01).alias("reported_p"), none.alias("reported_es"))


def _recheck(rows):
    return lambda spark, sf_dir: statcheck.recheck(rows(spark, sf_dir)).select("case_id", "status", "p_value", "matches", "verdict")


def reported_large(spark, sf_dir):
    """Tests with thousands to a million degrees of freedom: rows of each line number, and fifty times as many."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n")).select("l_linenumber", (C("l_linenumber") * 0.2 + 1.5).alias("stat"), F.explode(F.array(C("n") - 3, (C("n") - 3) * 50)).alias("df"))
    tests = [F.struct(F.lit(i).alias("i"), F.lit(t).alias("test"), (x).alias("stat")) for i, (t, x) in enumerate((("t", C("stat")), ("F", C("stat") + 1), ("r", C("stat") / F.sqrt(C("stat") * C("stat") + C("df")))))]
    rows = g.select("l_linenumber", "df", F.inline(F.array(*tests)))
    none = F.lit(None).cast("double")
    case = F.concat_ws("/", "test", C("l_linenumber").cast("string"), C("df").cast("string"))
    return rows.select(case.alias("case_id"), "test", (C("df") + 2).alias("n"), "df", F.lit(2.0).alias("df1"), C("df").cast("double").alias("df2"), "stat", F.lit(0.05).alias("reported_p"), none.alias("reported_es"))


def reported_fractional(spark, sf_dir):
    none = F.lit(None).cast("double")
    return _case(spark, sf_dir).select("case_id", F.lit("chi2").alias("test"), none.alias("n"), (C("case_id") * 0.35 + 0.4).alias("df"), none.alias("df1"), none.alias("df2"), (C("stat") * 2).alias("stat"), F.lit(0.05).alias("reported_p"), none.alias("reported_es"))


def effect_kinds(spark, sf_dir):
    """Correlations whose statistic is the coefficient or its t, as a column tells."""
    rows = _case(spark, sf_dir).select("case_id", F.lit("corr").alias("test"), (C("case_id") + 1).alias("n"), F.lit(None).cast("double").alias("df1"), F.lit(None).cast("double").alias("df2"), (C("stat") / 8).alias("stat"), F.when(C("case_id") % 2 == 0, "r").otherwise("t").alias("stat_kind"), F.lit(0.5).alias("reported_es"))
    return statcheck.effect_sizes(rows).select("case_id", "stat_kind", "status", "implied_es", "size_class", "agreement")


def effect_rows(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("t", "t_paired", "corr", "anova", "chisq", "sign")]), (C("case_id") % 6 + 1).cast("int"))
    return _case(spark, sf_dir).select("case_id", kind.alias("test"), (C("case_id") * 2 + 6).alias("n"), F.lit(None).cast("double").alias("df1"), F.lit(None).cast("double").alias("df2"), C("stat"), (C("case_id") * 0.03).alias("reported_es"))


def effect_sizes(spark, sf_dir):
    return statcheck.effect_sizes(effect_rows(spark, sf_dir)).select("case_id", "test", "status", "implied_es", "cohens_f", "odds_ratio", "size_class", "es_gap", "agreement")


def df_consistency(spark, sf_dir):
    design = F.element_at(F.array(*[F.lit(x) for x in ("independent_t", "paired_t", "correlation", "anova_between")]), (C("l_linenumber") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(design.alias("design"), C("l_quantity").cast("long").alias("n"), (C("l_orderkey") % 50).alias("df"), F.lit(3).alias("groups"))
    return statcheck.df_consistency(rows).groupBy("design").agg(F.count("*").alias("n_cases"), F.count_if("consistent").alias("n_consistent"), F.sum("implied_n").alias("sum_implied"))


def tagged(spark, sf_dir) -> DataFrame:
    """Documents with DOIs appended: good, retracted, malformed and unknown ones."""
    n = C("doc_id").cast("string")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" See doi:10.1234/abc."), n, F.lit("), also 10.12/x"), n, F.lit("; <10.98765/Q-"), (C("doc_id") % 7).cast("string"), F.lit("> and 10.5555/RET"), (C("doc_id") % 5).cast("string"), F.lit('", 11.1234/no 10.1234/.'))
    return table(spark, sf_dir, "documents").select("doc_id", "source", text.alias("text"))


def doi_extract(spark, sf_dir):
    return citations.extract(tagged(spark, sf_dir), ["doc_id"], "text")


def _works(spark, sf_dir):
    """A work for each document; those of two documents in three are under DOIs that no text refers to."""
    doi = F.concat(F.when(C("doc_id") % 3 == 0, "10.1234/ABC.").otherwise("10.1234/UNCITED."), C("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select(doi.alias("doi"), C("source").alias("title")).union(spark.range(7).select(F.concat(F.lit("10.98765/q-"), C("id").cast("string")), F.lit("journal")))


def doi_summary(spark, sf_dir):
    refs = citations.extract(tagged(spark, sf_dir), ["doc_id", "source"], "text").unionByName(tagged(spark, sf_dir).select("doc_id", "source", F.lit("10.12/x").alias("doi")))
    return citations.summary(citations.check(refs, _works(spark, sf_dir)), ["source"])


def retraction_join(spark, sf_dir):
    bad = spark.range(3).select(F.concat(F.lit("10.5555/ret"), C("id").cast("string")).alias("doi"))
    refs = citations.extract(tagged(spark, sf_dir), ["doc_id", "source"], "text")
    return citations.retracted(refs, bad).groupBy("source").agg(F.count("*").alias("total"), F.count_if("retracted").alias("n_retracted"))


def grids(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", images.average_hash(C("embedding")).alias("h"))


def image_hash(spark, sf_dir):
    return grids(spark, sf_dir).select("vec_id", F.lower(F.lpad(F.hex("h"), 16, "0")).alias("ahash"))


def image_pairs(spark, sf_dir):
    return images.similar_images(grids(spark, sf_dir), "vec_id", "h", 15)


def pixels(spark, sf_dir):
    """64x64 images from 64 vectors each; every second image repeats its top left quarter at the bottom right."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(C("vec_id") / 64).alias("image_id"), (C("vec_id") % 64).alias("tile"), F.posexplode("embedding").alias("p", "v"))
    v = F.floor((C("v").cast("double") + 1) * 127.5).cast("double")
    x, y = (C("tile") % 8) * 8 + C("p") % 8, F.floor(C("tile") / 8) * 8 + F.floor(C("p") / 8)
    out = e.select("image_id", x.cast("int").alias("x"), y.cast("int").alias("y"), v.alias("v"))
    copy = out.where("image_id % 2 = 0 and x < 32 and y < 32").select("image_id", (C("x") + 32).alias("x"), (C("y") + 32).alias("y"), "v")
    kept = out.where("not (image_id % 2 = 0 and x >= 32 and y >= 32)")
    return kept.unionByName(copy).withColumn("width", F.lit(64)).withColumn("height", F.lit(64))


def image_clones(spark, sf_dir):
    return images.clones(images.regions(pixels(spark, sf_dir), "image_id"), "image_id")


def exif_rows(spark, sf_dir):
    """Metadata of one image for each event: up to three time stamps, whose dates agree for two of the types."""
    name = F.element_at(F.array(*[F.lit(x) for x in ("Adobe Photoshop 24", "GIMP 2.10", "Illustrator", "Matplotlib 3", "Inkscape", "Canon", None)]), (C("event_id") % 7 + 1).cast("int"))
    day = F.concat(F.lit("2024:01:0"), F.when(C("event_type").isin("view", "click"), 1).otherwise(C("event_id") % 3 + 1).cast("string"), F.lit(" 10:00:00"))
    digitized = F.when((C("event_type") == "signup") & (C("event_id") % 2 == 0), "2024:01:05 08:00:00")
    whole = F.map_filter(F.create_map(F.lit("Software"), name, F.lit("DateTime"), F.when(C("event_id") % 4 != 0, day), F.lit("DateTimeOriginal"), F.lit("2024:01:01 09:00:00"), F.lit("DateTimeDigitized"), digitized), lambda k, v: v.isNotNull())
    return table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.when(C("event_id") % 5 != 0, whole).alias("exif"), F.when(C("event_id") % 11 == 0, "unreadable").alias("error"))


def metadata_map(spark, sf_dir):
    props = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "map<string,string>").alias("m"))
    return props.select("event_type", F.explode("m").alias("key", "value")).groupBy("event_type", "key").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))


def spaced(spark, sf_dir) -> DataFrame:
    """Documents whose lines are paragraphs, between blank lines, in every second one."""
    return table(spark, sf_dir, "documents").withColumn("text", F.when(C("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\n\n"))).otherwise(C("text")))


def style(spark, sf_dir):
    return stylometry.features(spaced(spark, sf_dir), "text", ["doc_id"])


def llm_score(spark, sf_dir):
    return stylometry.likelihood(style(spark, sf_dir)).select("doc_id", "status", "points", "possible", "pct", "verdict")


def dedup_minhash(spark, sf_dir):
    """Each document whose id is divisible by 50 is looked for in all documents."""
    docs = table(spark, sf_dir, "documents")
    return overlap.against_corpus(docs.where("doc_id % 50 = 0"), docs, "doc_id", "text")


def repeated(spark, sf_dir) -> DataFrame:
    """Documents, every hundredth of which stands twice in its text."""
    return table(spark, sf_dir, "documents").withColumn("text", F.when(C("doc_id") % 100 == 3, F.concat_ws(" ", "text", "text")).otherwise(C("text")))


def self_duplicates(spark, sf_dir):
    return overlap.repeated_passages(repeated(spark, sf_dir), "doc_id", "text", most=None)


def p_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(C("l_returnflag").alias("paper_id"), C("l_tax").alias("p"))


def rule_adjusted(spark, sf_dir):
    rows = _case(spark, sf_dir).select((C("case_id") % 4).alias("family"), "case_id", (F.round(C("stat") / 100, 4)).alias("p"))
    return rules.adjusted_p(rows, ["family"], "case_id", "p")


def rule_alpha(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity")
    return rules.cronbach_alpha(rows, ["l_returnflag"], "l_orderkey", "l_linenumber", "l_quantity")


def rule_power(spark, sf_dir):
    rows = _case(spark, sf_dir).select("case_id", (C("stat") / 10).alias("d"), (C("case_id") + 4).alias("n"), F.lit(0.01).alias("p"))
    return rules.underpowered(rows, "d", "n", "p").select("case_id", "d", "n", "power")


def matrices(spark, sf_dir):
    """Correlations of three variables for each supplier, some with a cell changed."""
    g = table(spark, sf_dir, "lineitem").groupBy(C("l_suppkey").alias("paper_id")).agg(F.corr("l_quantity", "l_extendedprice").alias("r12"), F.corr("l_quantity", "l_discount").alias("r13"), F.corr("l_extendedprice", "l_tax").alias("r23"))
    k, odd = C("paper_id"), C("paper_id") % 3 == 0
    scale = F.when(k % 4 == 3, 1.2).otherwise(1.0)
    r12, r13, r23 = C("r12") * scale, F.when(odd, C("r12")).otherwise(C("r13")) * scale, F.when(odd, -C("r12")).otherwise(C("r23")) * scale
    cells = {(1, 1): F.lit(1.0), (2, 2): F.lit(1.0), (3, 3): F.when(k % 4 == 2, 0.98).otherwise(1.0), (1, 2): r12, (2, 1): F.when(k % 4 == 1, r12 * 0.5).otherwise(r12), (1, 3): r13, (3, 1): r13, (2, 3): r23, (3, 2): r23}
    return g.select("paper_id", F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), r.alias("r")) for (i, j), r in cells.items()])))


def work_records(spark, sf_dir):
    """A bibliographic record for each document, with parts missing in turn."""
    d, c = C("doc_id"), lambda x: x.cast("string")
    authors = F.when(d % 6 == 0, F.array().cast("array<struct<family:string,given:string>>")).otherwise(F.transform(F.sequence(F.lit(1), (d % 5 + 1).cast("int")), lambda i: F.struct(F.concat(F.lit("F"), c(d % 100), F.lit("_"), c(i)).alias("family"), F.concat(F.lit("G"), c(i)).alias("given"))))
    dated = lambda gap, base: F.when(d % gap != 0, F.struct(F.array(F.array((d % 25 + base).cast("int"))).alias("date_parts")))
    update = F.when(d % 8 == 0, F.array(F.struct(F.lit("correction").alias("type"), F.lit("10.1/c").alias("DOI"), F.lit(None).cast("string").alias("reason")), F.struct(F.lit("retraction").alias("type"), F.concat(F.lit("10.1/r"), c(d)).alias("DOI"), F.when(d % 16 == 0, "data").alias("reason"))))
    work = F.struct(
        F.when(d % 10 != 0, F.array(C("source"))).alias("title"), authors.alias("author"), F.when(d % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("lang")).alias("container_title"),
        dated(3, 2000).alias("published_print"), dated(2, 1980).alias("published_online"), dated(5, 1960).alias("issued"), F.when(d % 7 != 0, "press").alias("publisher"), F.when(d % 9 != 0, "article").alias("type"), update.alias("update-to"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.when(d % 11 != 0, work).alias("work"))


def work_updates(spark, sf_dir):
    return work_records(spark, sf_dir).select("doc_id", citations.update_status(C("work")).alias("u")).select("doc_id", "u.*")


def retraction_pages(spark, sf_dir):
    """A listing in pages of a hundred, the tenth of which could not be read."""
    at = F.floor(C("c_custkey") / 100) * 100
    pages = table(spark, sf_dir, "customer").groupBy(at.alias("start")).agg(F.collect_list(F.struct(F.concat(F.lit("10.5555/C"), C("c_custkey").cast("string")).alias("DOI"))).alias("items"))
    return citations.from_pages(pages.withColumn("items", F.when(C("start") != 900, C("items"))))


def _scratch(spark) -> str:
    return f"{sources.shared_folder(spark)}/sources-{uuid.uuid4().hex}"


def _priced(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(C("o_orderkey") % 7 == 0, "n/a").otherwise(C("o_totalprice").cast("string")).alias("price"))


def _total(df):
    return df.agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def source_csv(spark, sf_dir):
    _priced(spark, sf_dir).write.option("header", True).csv(path := _scratch(spark))
    return _total(sources.csv_column(spark, path, "price"))


def source_lines(spark, sf_dir):
    _priced(spark, sf_dir).select(F.concat(F.lit(" "), "price")).write.text(path := _scratch(spark))
    return _total(sources.number_lines(spark, path))


def source_inline(spark, sf_dir):
    rows = [str(r["n_regionkey"]) for r in table(spark, sf_dir, "nation").select("n_regionkey").collect()]  # 25 rows at any size
    return _total(sources.inline_numbers(spark, ", ".join([*rows, "x", "", "2.5"])))


def source_reported(spark, sf_dir):
    rows = _case(spark, sf_dir).select(F.lit("t").alias(" Test"), F.when(C("case_id") % 5 != 0, C("case_id").cast("string")).otherwise("many").alias("n"), F.when(C("case_id") % 7 != 0, C("stat").cast("string")).alias("stat "))
    rows.write.option("header", True).csv(path := _scratch(spark))
    return sources.reported_statistics(spark, path).groupBy("status").agg(F.count("*").alias("n_rows"), F.sum("n").alias("sum_n"), F.round(F.sum("stat"), 2).alias("sum_stat"))


def source_bits(spark, sf_dir):
    table(spark, sf_dir, "supplier").select("s_name").write.text(path := _scratch(spark))
    return sources.byte_bits(spark, f"{path}/*.txt").agg(F.count("*").alias("n_bits"), F.sum("bit").alias("n_ones"))


def source_texts(spark, sf_dir):
    table(spark, sf_dir, "documents").select(F.regexp_replace(F.coalesce("text", F.lit("")), "[\r\n]+", " ")).write.text(path := _scratch(spark))
    return sources.texts(spark, path).agg(F.sum(F.length("text")).alias("n_chars"))


def source_dois(spark, sf_dir):
    row = F.when(C("s_suppkey") % 4 == 0, F.concat(F.lit("# "), "s_name")).when(C("s_suppkey") % 4 == 1, "  ").otherwise(F.concat(F.lit(" 10.1234/s"), C("s_suppkey").cast("string"), F.lit(" ")))
    table(spark, sf_dir, "supplier").select(row).write.text(path := _scratch(spark))
    return sources.doi_list(spark, path)


def source_files(spark, sf_dir):
    names = table(spark, sf_dir, "region").agg(F.array_join(F.array_sort(F.collect_list("r_name")), "\n").alias("names"))  # five rows at any size
    names.coalesce(1).write.text(path := _scratch(spark))
    return sources.files(spark, path, "*.txt").select("length", "file_hash")


def source_cache(spark, sf_dir):
    """DOIs of two pages, some in both, written as a cache and read again; a missing cache adds none."""
    doi = lambda keys: table(spark, sf_dir, "supplier").where(keys).select(F.concat(F.lit("10.5555/S"), C("s_suppkey").cast("string")).alias("doi"))
    sources.write_cache(doi("s_suppkey % 2 = 0").union(doi("s_suppkey % 3 = 0")), path := _scratch(spark))
    return sources.retraction_cache(spark, path).union(sources.retraction_cache(spark, f"{path}-missing")).distinct()


def image_decode(spark, sf_dir):
    """Embeddings as PGM files, decoded and hashed."""
    pixel = lambda v: F.lpad(F.hex(F.least(F.greatest(F.floor((v.cast("double") + 1) * 127.5), F.lit(0)), F.lit(255)).cast("int")), 2, "0")
    content = F.unhex(F.concat(F.hex(F.lit("P5 8 8 255\n")), F.array_join(F.transform("embedding", pixel), "")))
    files = table(spark, sf_dir, "embeddings").select(C("vec_id").cast("string").alias("path"), content.alias("content"))
    return images.decoded(files).select(C("path").cast("long").alias("vec_id"), F.lower(F.lpad(F.hex(images.average_hash(C("pixels"))), 16, "0")).alias("ahash"), "error")


def phrased(spark, sf_dir):
    """Documents to which some of the phrases are appended."""
    text = F.concat_ws(" ", "text", F.when(C("doc_id") % 9 == 0, "As an AI language model, I cannot say."), F.when(C("doc_id") % 7 == 0, "I don't have access to it."))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def rule_registration(spark, sf_dir):
    """Orders as trials; the registry knows them by another order's priority, three keys on."""
    trials = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("trial"), C("o_orderpriority").alias("endpoint"))
    registry = trials.select((C("trial") + 3).alias("trial"), "endpoint")
    return rules.registration(trials, registry, "trial", "endpoint").groupBy("problem").agg(F.count("*").alias("n"))


def rule_regressions(spark, sf_dir):
    steps = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(((F.max("l_discount") - 0.05) * 24).alias("beta"), F.max("l_quantity").alias("r2"))
    return rules.regressions(steps, ["l_orderkey"], "l_linenumber", "beta", "r2").groupBy("problem").agg(F.count("*").alias("n"))


def rule_recruitment(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("days"))
    return rules.recruitment(per, "n", "days", 0.02)


def all_findings(spark, sf_dir) -> DataFrame:
    """Findings on sources of documents, customer segments and event types, under one paper_id each."""
    tag = report.severity_of
    b = digits.benford(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"])
    benford = report.findings(b, C("o_orderpriority"), 1, "1.2", "benford", F.when(C("verdict") == "SIGNIFICANT", "HIGH").when(C("verdict") == "SUSPICIOUS", "MEDIUM"), C("chi2"))
    l = digits.last_digits(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"])
    last = report.findings(l, C("o_orderpriority"), 1, "1.2", "last_digit", F.when(~C("natural"), "MEDIUM"), C("chi2"))
    u = distribution.uniform_chi2(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"])
    uniform = report.findings(u, C("o_orderpriority"), 2, "2.1", "uniform", F.when(C("uniform_like"), "HIGH"), C("chi2"))
    s = stylometry.likelihood(style(spark, sf_dir)).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count_if(C("verdict").isin("VERY_LIKELY_LLM", "LIKELY_ASSISTED")).alias("n"))
    text = report.findings(s, C("source"), 1, "1.1", "style", F.when(C("n") >= 10, "MEDIUM").when(C("n") > 0, "LOW"), C("n"))
    r = retraction_join(spark, sf_dir)
    cited = report.findings(r, C("source"), 1, "1.3", "retracted", F.when(C("n_retracted") > 0, tag(F.lit("CRIT"))), C("n_retracted"))
    return report.union([benford, last, uniform, text, cited])


def risk_rollup(spark, sf_dir):
    papers = table(spark, sf_dir, "documents").select(C("source").alias("paper_id")).union(table(spark, sf_dir, "orders").select("o_orderpriority")).union(spark.range(2).select(F.concat(F.lit("clean"), C("id").cast("string"))))
    return report.rollup(all_findings(spark, sf_dir), papers)


T = table
QUERIES = {
    "benford_audit": lambda s, d: digits.benford(T(s, d, "events"), "value", ["event_type"]),
    "benford_orders": lambda s, d: digits.benford(T(s, d, "orders"), "o_totalprice", ["o_orderpriority"]),
    "benford_digits": lambda s, d: digits.benford_digits(T(s, d, "lineitem"), "l_extendedprice", ["l_returnflag"]),
    "last_digit": lambda s, d: digits.last_digits(T(s, d, "lineitem"), "l_extendedprice", ["l_returnflag"]),
    "uniform_chi2": lambda s, d: distribution.uniform_chi2(T(s, d, "customer"), "c_acctbal", ["c_mktsegment"]),
    "moments": lambda s, d: distribution.moments(T(s, d, "lineitem"), "l_quantity", ["l_returnflag", "l_linestatus"]).select("l_returnflag", "l_linestatus", "n", *[F.round(c, 6).alias(c) for c in ("mean", "variance", "sd", "skewness", "kurtosis")]),
    "normality": lambda s, d: distribution.normality(T(s, d, "events"), "value", ["event_type"]),
    "anderson_darling": lambda s, d: distribution.anderson_darling(T(s, d, "customer"), "c_acctbal", ["c_mktsegment"]).select("c_mktsegment", "n", F.round("a2", 4).alias("a2")),
    "runs_test": lambda s, d: distribution.runs_test(T(s, d, "events"), C("value") > 50, ["ts", "event_id"], ["user_id"]),
    "p_curve": lambda s, d: pcurve.p_curve(p_rows(s, d), "p", ["paper_id"]),
    "stat_check_t": _recheck(reported_t),
    "stat_check_f": _recheck(reported_f),
    "stat_check_chi2": _recheck(reported_chi2),
    "stat_check_r": _recheck(reported_r),
    "df_consistency": df_consistency,
    "effect_sizes": effect_sizes,
    "stylometry": style,
    "llm_score": llm_score,
    "stat_check_large": lambda s, d: statcheck.recheck(reported_large(s, d)).select("case_id", "df", "status", "p_value", "matches", "verdict"),
    "stat_check_fractional": lambda s, d: statcheck.recheck(reported_fractional(s, d)).select("case_id", "status", "p_value"),
    "effect_kinds": effect_kinds,
    "normality_report": lambda s, d: distribution.normality_report(T(s, d, "events"), "value", ["event_type"]),
    "benford_kinds": lambda s, d: digits.of_kind(digits.benford(T(s, d, "orders"), "o_totalprice", ["o_orderpriority"]), F.when(C("o_orderpriority").startswith("1"), "financial").when(C("o_orderpriority").startswith("2"), "price")).select("o_orderpriority", "n", "verdict", "applicable"),
    "dedup_pairs": lambda s, d: overlap.similar_pairs(T(s, d, "documents"), "doc_id", "text"),
    "dedup_minhash": dedup_minhash,
    "self_duplicates": self_duplicates,
    "contamination": lambda s, d: overlap.contamination(T(s, d, "documents"), T(s, d, "benchmark"), "doc_id", "item_id", "text"),
    "doi_extract": doi_extract,
    "doi_summary": doi_summary,
    "retraction_join": retraction_join,
    "doi_listed": lambda s, d: citations.listed(tagged(s, d), "text"),
    "work_metadata": lambda s, d: work_records(s, d).select("doc_id", *citations.work_fields(C("work")), *citations.work_kind(C("work"))),
    "work_updates": work_updates,
    "retraction_pages": retraction_pages,
    "source_csv": source_csv,
    "source_lines": source_lines,
    "source_inline": source_inline,
    "source_reported": source_reported,
    "source_bits": source_bits,
    "source_texts": source_texts,
    "source_dois": source_dois,
    "source_files": source_files,
    "source_cache": source_cache,
    "image_decode": image_decode,
    "image_totals": lambda s, d: images.whole_totals(grids(s, d), "label", "vec_id", "h", 15),
    "image_clone_report": lambda s, d: images.clone_report(images.clones(images.regions(pixels(s, d), "image_id"), "image_id", threshold=24), "image_id").select("image_id", "place", "n_more", "x1", "y1", "x2", "y2", "distance"),
    "image_hash": image_hash,
    "image_pairs": image_pairs,
    "image_clones": image_clones,
    "exif_inspect": lambda s, d: metadata.inspect(exif_rows(s, d), ["event_id"]),
    "exif_summary": lambda s, d: metadata.summary(exif_rows(s, d), ["event_type"]),
    "metadata_map": metadata_map,
    "digit_windows": lambda s, d: digit_windows(T(s, d, "events"), "ts", "value", ["event_type"]).select("window_start", "event_type", "n", "c1", "c9", "last0", "last9"),
    "rule_impossible_p": lambda s, d: rules.impossible_p(p_rows(s, d), "p").groupBy("paper_id", "problem").agg(F.count("*").alias("n")),
    "rule_same_p": lambda s, d: rules.same_p(T(s, d, "lineitem").select("l_orderkey", "l_tax"), "l_orderkey", "l_tax"),
    "rule_identical_summaries": lambda s, d: rules.identical_summaries(T(s, d, "lineitem").select("l_orderkey", "l_tax", "l_discount"), "l_orderkey", "l_tax", "l_discount"),
    "rule_changing_n": lambda s, d: rules.changing_n(T(s, d, "lineitem"), "l_partkey", "l_returnflag", "l_linenumber"),
    "rule_prolific": lambda s, d: rules.prolific(T(s, d, "orders"), "o_custkey", F.year("o_orderdate"), 3),
    "rule_over_citation": lambda s, d: rules.over_citation(T(s, d, "lineitem"), "l_orderkey", "l_suppkey", 0.4),
    "rule_citation_rings": lambda s, d: rules.citation_rings(T(s, d, "lineitem").select((C("l_suppkey") % 50).alias("x"), (C("l_partkey") % 50).alias("y")), "x", "y", 5),
    "rule_mill": lambda s, d: rules.corresponding_mill(T(s, d, "lineitem"), "l_suppkey", "l_partkey", 20),
    "rule_straight_lining": lambda s, d: rules.straight_lining(T(s, d, "lineitem"), "l_orderkey", "l_linestatus", 5),
    "rule_alternating": lambda s, d: rules.alternating(T(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (C("l_suppkey") % 2).alias("x")), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "x", 5),
    "rule_speeding": lambda s, d: rules.speeding(T(s, d, "events"), "event_id", "value", ["event_type"]).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.max("median"), 6).alias("median")),
    "rule_duplicate_keys": lambda s, d: rules.duplicate_keys(T(s, d, "events"), ["user_id", "value"]),
    "rule_alpha": rule_alpha,
    "rule_r2": lambda s, d: rules.fit(T(s, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity"),
    "rule_adjusted_p": rule_adjusted,
    "rule_power": rule_power,
    "rule_matrix": lambda s, d: rules.correlation_matrix(matrices(s, d), "paper_id", "i", "j", "r").select("paper_id", "i", "j", F.round("r", 6).alias("r"), "problem"),
    "rule_psd": lambda s, d: rules.not_positive_definite(matrices(s, d), "paper_id", "i", "j", "r"),
    "rule_equal_counts": lambda s, d: rules.equal_counts(T(s, d, "lineitem"), ["l_orderkey"], "l_quantity"),
    "rule_monotone": lambda s, d: rules.monotone(T(s, d, "lineitem"), ["l_orderkey"], "l_linenumber", "l_quantity"),
    "rule_model_phrases": lambda s, d: rules.model_phrases(phrased(s, d), "text").groupBy("phrases").agg(F.count("*").alias("n")),
    "rule_ci": lambda s, d: rules.ci_contradicts(T(s, d, "lineitem").select("l_returnflag", (C("l_discount") - 0.045).alias("low"), (C("l_discount") - 0.015).alias("high"), "l_tax"), "low", "high", "l_tax").groupBy("l_returnflag").agg(F.count("*").alias("n")),
    "rule_precision": lambda s, d: rules.excess_precision(T(s, d, "customer").select("c_mktsegment", C("c_acctbal").cast("string").alias("raw")), "raw", 1).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.max("decimals").alias("most")),
    "rule_recruitment": rule_recruitment,
    "rule_salami": lambda s, d: overlap.paper_mill(T(s, d, "documents"), "doc_id", "text", "source"),
    "rule_similar_mill": lambda s, d: rules.similar_mill(T(s, d, "documents"), "source", "doc_id", "doc_id", "text"),
    "rule_absent_bars": lambda s, d: rules.absent_bars(T(s, d, "lineitem"), ["l_orderkey"], "l_discount"),
    "rule_weak_instruments": lambda s, d: rules.weak_instruments(_case(s, d).select("case_id", (C("stat") * C("case_id") / 10).alias("f")), "f").select("case_id", F.round("f", 4).alias("f")),
    "rule_yields": lambda s, d: rules.yields(T(s, d, "lineitem").select("l_returnflag", (C("l_quantity") * 2.1).alias("percent"), "l_linenumber"), "percent", "l_linenumber").groupBy("l_returnflag").agg(F.count("*").alias("n")),
    "rule_elemental": lambda s, d: rules.elemental(T(s, d, "lineitem").select("l_returnflag", (C("l_tax") * 50).alias("found"), (C("l_discount") * 50).alias("calculated")), "found", "calculated").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("off"), 2).alias("off")),
    "rule_regressions": rule_regressions,
    "rule_resolution": lambda s, d: rules.resolution_spread(T(s, d, "part"), "p_brand", "p_size", "p_retailprice"),
    "rule_missing_n": lambda s, d: rules.missing_n(T(s, d, "lineitem").select("l_returnflag", F.nullif("l_linenumber", F.lit(3)).alias("n")), "n").groupBy("l_returnflag").agg(F.count("*").alias("n_missing")),
    "rule_registration": rule_registration,
    "report_benford": lambda s, d: lines.benford(digits.benford(T(s, d, "orders"), "o_totalprice", ["o_orderpriority"]), "o_orderpriority"),
    "report_normality": lambda s, d: lines.normality(distribution.normality_report(T(s, d, "events"), "value", ["event_type"]), "event_type"),
    "report_statistics": lambda s, d: lines.rechecked(statcheck.recheck(reported_t(s, d)), "case_id"),
    "report_effects": lambda s, d: lines.effects(statcheck.effect_sizes(effect_rows(s, d)), "case_id"),
    "report_overlaps": lambda s, d: lines.overlaps(overlap.similar_pairs(T(s, d, "documents"), "doc_id", "text")),
    "report_passages": lambda s, d: lines.passages(overlap.repeated_passages(repeated(s, d), "doc_id", "text").withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("first", "second"))), "doc_id"),
    "report_images": lambda s, d: lines.images(images.totals(grids(s, d), image_pairs(s, d), "label", "vec_id"), "label"),
    "report_clones": lambda s, d: lines.clones(images.clone_report(images.clones(images.regions(pixels(s, d), "image_id"), "image_id", threshold=24), "image_id"), "image_id"),
    "report_metadata": lambda s, d: lines.metadata(metadata.summary(exif_rows(s, d), ["event_type"]), "event_type"),
    "report_references": lambda s, d: lines.references(doi_summary(s, d), "source"),
    "report_risks": lambda s, d: lines.risks(risk_rollup(s, d)),
    "rule_reverse_items": lambda s, d: rules.reverse_items(T(s, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_discount"),
    "risk_rollup": risk_rollup,
}
