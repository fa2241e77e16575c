"""Text ingest, file round trips and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochwise import session
from epochwise.functions.exprs import METRICS
from epochwise.operators import evaluate, ordering, profile, retrieval, text_index
from epochwise.plans import q_evaluate, q_profile  # noqa: F401  their SQL views are used here
from epochwise.plans.hubs import CHANNELS, FEATS, Hub, add_view, with_views
from epochwise.plans.q_events import splits_frame
from epochwise.plans.registry import query
from epochwise.sources import annotations, files

# --- annotation text: one text per user, day and thousand event ids, derived from the error
# events; the id range bounds the size of a text ------------------------------------------------

DAYKEY = "CAST(user_id AS VARCHAR) || '_' || strftime(ts, '%d') || '_' || CAST(event_id // 1000 AS VARCHAR)"
SOD = "(hour(ts) * 3600 + minute(ts) * 60 + second(ts))"


def _user_day(t: Hub):
    ts = F.col("ts")
    sod = (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("bigint")
    part = F.floor(F.col("event_id") / 1000).cast("string")
    path = F.concat_ws("_", F.col("user_id").cast("string"), F.date_format(ts, "dd"), part)
    return t.table("events").select(path.alias("path"), "ts", "event_id", "event_type", "value", sod.alias("sod"))


def _texts(rows, line):
    """Join the lines of a path (at most a thousand), in time order, into one text."""
    item = F.struct("ts", "event_id", line.alias("line"))
    return rows.groupBy("path").agg(F.sort_array(F.collect_list(item)).alias("l"), F.min("sod").alias("reg"))


@query(
    "parse_intervals",
    f"""SELECT {DAYKEY} || '.edf' AS recording, CAST({SOD} AS BIGINT) AS start_s,
    CAST({SOD} + CAST(floor(value) AS INT) AS BIGINT) AS end_s FROM events WHERE event_type = 'error' AND value <= 100""",
)
def parse_intervals(t: Hub):
    """Text is written from the events, starts above 100 without an end, and parsed again."""
    rows = _user_day(t).filter("event_type = 'error'")
    start = F.concat(F.lit("Seizure 1 Start Time: "), F.col("sod").cast("string"), F.lit(" seconds\n"))
    end = F.concat(F.lit("Seizure 1 End Time: "), (F.col("sod") + F.floor("value")).cast("string"), F.lit(" seconds\n"))
    made = _texts(rows, F.concat(start, F.when(F.col("value") <= 100, end).otherwise("")))
    text = F.concat(F.lit("File Name: "), F.col("path"), F.lit(".edf\n"), F.array_join("l.line", ""))
    return annotations.parse_intervals(made.select("path", text.alias("text"))).drop("path")


_CLOCK = "strftime(ts, '%H.%M.%S')"


@query(
    "clock_offsets",
    f"""WITH e AS (SELECT {DAYKEY} AS path, ts, {SOD} AS sod, event_type, value FROM events WHERE event_type = 'error'),
    r AS (SELECT path, min(sod) AS reg FROM e GROUP BY path),
    o AS (SELECT e.path, (sod + 3600 - (reg + 7200) % 86400 + 172800) % 86400 AS s,
    (sod + 3600 + 5400 - (reg + 7200) % 86400 + 172800) % 86400 AS e FROM e JOIN r ON e.path = r.path)
    SELECT path, CAST(s AS BIGINT) AS start_s, CAST(CASE WHEN e < s THEN e + 86400 ELSE e END AS BIGINT) AS end_s FROM o""",
)
def clock_offsets(t: Hub):
    """Clock text with both separators; many of the offsets wrap over midnight."""
    rows = _user_day(t).filter("event_type = 'error'")

    def clock(seconds, sep):
        s = F.pmod(seconds, F.lit(86400))
        two = [F.lpad(p.cast("string"), 2, "0") for p in (F.floor(s / 3600), F.floor(s % 3600 / 60), (s % 60).cast("bigint"))]
        return F.concat_ws(sep, *two)

    line = F.concat(
        F.lit("Start time: "), clock(F.col("sod") + 3600, "."), F.lit("\nEnd time: "), clock(F.col("sod") + 9000, ":"), F.lit("\n")
    )
    made = _texts(rows, line)
    text = F.concat(
        F.lit("Registration start time: "), clock(F.col("reg") + 7200, "."), F.lit("\n"), F.array_join("l.line", "\n")
    )
    return annotations.clock_offsets(made.select("path", text.alias("text")))


@query(
    "discover",
    """SELECT source AS subject, count(*) AS files FROM documents WHERE doc_id % 10 <> 0 GROUP BY source""",
)
def discover(t: Hub):
    """Paths named after the source, a part letter and the document; a tenth are re-downloads."""
    part = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("doc_id") % 3 + 1).cast("int"))
    path = F.concat(
        F.lit("/data/"),
        F.col("source"),
        part,
        F.lit("_"),
        F.col("doc_id").cast("string"),
        F.when(F.col("doc_id") % 10 == 0, ".edf.1").otherwise(".edf"),
    )
    found = files.discover(t.table("documents").select(path.alias("path")))
    return found.groupBy("subject").agg(F.count(F.lit(1)).alias("files"))


@query(
    "cache_roundtrip",
    with_views("emb")
    + """SELECT subject, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round(avg(f01), 6) AS f01 FROM emb
    WHERE subject IN ('s1', 's3', 's4') GROUP BY subject""",
)
def cache_roundtrip(t: Hub):
    path = session.scratch_path(t.spark, "cache")
    files.write_cache(t.emb, path, id_col="id")
    back = files.read_cache(t.spark, path, t.emb.schema, ["s1", "s3", "s4"])
    return back.groupBy("subject").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"), F.round(F.avg("f01"), 6).alias("f01")
    )


@query(
    "parse_bib",
    """SELECT 'doc' || CAST(doc_id AS VARCHAR) AS key, 'Notes on ' || upper(lang) || ' of ' || CAST(n_chars AS VARCHAR) || ' signs' AS title,
    'Proc ' || source AS journal, CAST(1990 + doc_id % 30 AS VARCHAR) AS year FROM documents""",
)
def parse_bib(t: Hub):
    """Entries with nested braces, a quoted field and a booktitle, five to a file."""
    d = F.col("doc_id")
    entry = F.concat(
        F.lit("@article{doc"),
        d.cast("string"),
        F.lit(",\n  title = {Notes on {"),
        F.upper("lang"),
        F.lit("} of\n {{"),
        F.col("n_chars").cast("string"),
        F.lit("}} signs},\n  "),
        F.when(d % 2 == 0, "journal").otherwise("booktitle"),
        F.lit(' = "Proc '),
        F.col("source"),
        F.lit('",\n  year = '),
        (1990 + d % 30).cast("string"),
        F.lit("\n}\n"),
    )
    made = t.table("documents").select(F.floor(d / 5).alias("path"), entry.alias("e"))
    texts = made.groupBy("path").agg(F.array_join(F.collect_list("e"), "\n").alias("text"))
    return files.parse_bib(texts).select("key", "title", "journal", "year")


@query(
    "results_roundtrip",
    with_views("conf") + f"SELECT model, protocol, tp, tn, fp, fn, {q_evaluate.SUITE_ROUND} FROM conf",
)
def results_roundtrip(t: Hub):
    """Nested JSON out and in again, with an explicit schema."""
    suite = evaluate.with_metrics(evaluate.confusion(t.scored))
    nested = suite.select(
        "model", "protocol", F.struct("tp", "tn", "fp", "fn").alias("confusion"), F.struct(*METRICS).alias("metrics")
    )
    path = session.scratch_path(t.spark, "results")
    files.write_results(nested, path)
    back = files.read_results(t.spark, path, nested.schema)
    return back.select("model", "protocol", "confusion.*", *[F.round(f"metrics.{m}", 6).alias(m) for m in METRICS])


@query(
    "audit_append",
    with_views("conf_s")
    + """SELECT run_id, event, model, count(*) AS n, CAST(sum(tp) AS BIGINT) AS tp FROM conf_s,
    (VALUES ('run-1', 'subject_counts'), ('run-2', 'subject_counts')) AS v(run_id, event) GROUP BY ALL""",
)
def audit_append(t: Hub):
    """Two appends of one row per subject; the payload is parsed on reading."""
    counts = evaluate.confusion(t.scored, ["model", "protocol", "subject"])
    path = session.scratch_path(t.spark, "audit")
    for run in ("run-1", "run-2"):
        files.append_audit(files.audit_rows(counts, "subject_counts", run), path)
    back = files.read_audit(t.spark, path).withColumn("p", F.from_json("payload", counts.schema))
    return back.groupBy("run_id", "event", F.col("p.model").alias("model")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("p.tp").alias("tp")
    )


@query(
    "norm_stats",
    with_views("samples")
    + """SELECT channel, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std, round(quantile_cont(value, 0.5), 6) AS median,
    round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, count(*) AS n_samples FROM samples GROUP BY channel""",
)
def norm_stats(t: Hub):
    """Channel statistics through their nested JSON form."""
    rows = files.norm_stats_rows(files.norm_stats_json(profile.column_robust_stats(t.wide, CHANNELS)))
    return rows.select(
        "channel", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), F.round("median", 6).alias("median"), F.round("iqr", 6).alias("iqr"), "n_samples"
    )


_GF = "CAST('0x' || substr(md5('42:' || CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 5"


@query(
    "split_manifest",
    f"""SELECT 'events' AS dataset, split, count(*) AS n_subjects FROM (SELECT DISTINCT user_id, CASE WHEN {_GF} < 3 THEN 'train'
    WHEN {_GF} = 3 THEN 'validation' ELSE 'test' END AS split FROM events) GROUP BY split""",
)
def split_manifest(t: Hub):
    """Assignments as nested documents of at most a thousand subjects, exploded again."""
    ranked = ordering.hash_rank(splits_frame(t), ["split"], "subject", out="rn")
    part = F.floor((F.col("rn") - 1) / 1000)
    lists = ranked.groupBy(part.alias("part"), "split").agg(F.collect_list("subject").alias("ids"))
    split = F.struct(
        F.col("ids").alias("subject_ids"),
        F.size("ids").cast("bigint").alias("n_subjects"),
        F.lit(None).cast("bigint").alias("n_windows"),
        F.lit(None).cast("map<string,bigint>").alias("class_counts"),
    )
    data = F.struct(
        F.lit(None).cast("bigint").alias("total_subjects"),
        F.lit(None).cast("bigint").alias("total_windows"),
        F.lit(None).cast("map<string,bigint>").alias("class_distribution"),
        F.create_map(F.col("split"), split).alias("splits"),
    )
    doc = lists.select(F.to_json(F.struct(F.create_map(F.lit("events"), data).alias("datasets"))).alias("j"))
    parsed = doc.select(F.from_json("j", files.MANIFEST).alias("m")).select("m.*")
    rows = files.manifest_rows(parsed)
    return rows.groupBy("dataset", "split").agg(F.count(F.lit(1)).alias("n_subjects"))


# --- retrieval ---------------------------------------------------------------------------------

# A short stop list for the registered queries; the library default is Spark's.
STOPS = (
    "a an and are as at be by for from has he in is it its of on or that the this to was were will with"
).split()
_STOP_SQL = ", ".join(f"'{w}'" for w in STOPS)


def _toks(col: str) -> str:
    return f"list_filter(regexp_extract_all(lower({col}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_STOP_SQL}))"


def _terms(col: str) -> str:
    return f"""list_concat({col}, list_transform(CASE WHEN len({col}) > 1 THEN generate_series(1, len({col}) - 1) ELSE [] END,
    lambda i: {col}[i] || ' ' || {col}[i + 1]))"""


add_view("qtext", [], "SELECT text FROM benchmark ORDER BY item_id LIMIT 1")
add_view("toks", [], f"SELECT doc_id, {_toks('text')} AS toks FROM documents")
add_view("qtoks", ["qtext"], f"SELECT {_toks('text')} AS toks FROM qtext")
add_view("tf", ["toks"], f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_terms('toks')}) AS term FROM toks) GROUP BY ALL")
add_view("qtf", ["qtoks"], f"SELECT term, count(*) AS q_tf FROM (SELECT unnest({_terms('toks')}) AS term FROM qtoks) GROUP BY term")
add_view(
    "idf",
    ["tf", "qtf"],
    """SELECT coalesce(d.term, q.term) AS term, coalesce(q_tf, 0) AS q_tf, ln((2.0e0 + (SELECT count(*) FROM documents))
    / (1.0e0 + coalesce(df, 0) + CASE WHEN q_tf IS NULL THEN 0 ELSE 1 END)) + 1 AS idf
    FROM (SELECT term, count(*) AS df FROM tf GROUP BY term) d FULL JOIN qtf q ON d.term = q.term""",
)
add_view(
    "docw",
    ["tf", "idf"],
    """SELECT doc_id, count(*) AS terms, sqrt(sum(power(tf * idf, 2))) AS norm, max(tf * idf) AS mx, sum(tf * idf * q_tf * idf) AS dot
    FROM tf JOIN idf ON tf.term = idf.term GROUP BY doc_id""",
)
add_view("qnorm", ["idf"], "SELECT sqrt(sum(power(q_tf * idf, 2))) AS qn FROM idf")
add_view("cosine", ["docw", "qnorm"], "SELECT doc_id, coalesce(dot / (norm * qn), 0) AS cos FROM docw, qnorm")
add_view(
    "kw",
    ["qtext"],
    """SELECT doc_id, len(list_filter(words, lambda w: contains(low, w))) / CAST(len(words) AS DOUBLE) AS kw
    FROM (SELECT doc_id, lower(d.text) AS low, string_split_regex(trim(lower(q.text)), '\\s+') AS words
    FROM documents d, qtext q)""",
)
add_view(
    "hybrid",
    ["cosine", "kw"],
    """SELECT k.doc_id, coalesce(cos, 0) AS cos, kw, coalesce(cos, 0) * 0.7e0 + kw * 0.3e0 AS score
    FROM kw k LEFT JOIN cosine c ON k.doc_id = c.doc_id""",
)
add_view("best", ["hybrid"], "SELECT * FROM hybrid WHERE score > 0 ORDER BY score DESC, doc_id DESC LIMIT 5")


def corpus_of(t: Hub):
    return t.table("documents").select("doc_id", "text")


def index_of(t: Hub) -> text_index.TextIndex:
    """The stored index of this version of the documents; the first query that needs it builds it."""
    version = text_index.corpus_version(t.spark, f"{t.dir}/documents.parquet", STOPS)
    return text_index.open_index(corpus_of(t), f"{session.session_dir(t.spark)}/text-index/{version}", STOPS)


def query_text(t: Hub) -> str:
    """One text: the first benchmark item."""
    return t.table("benchmark").agg(F.min_by("text", "item_id")).first()[0]


@query(
    "tokens",
    with_views("toks")
    + f"""SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, CAST(len({_terms('toks')}) AS BIGINT) AS n_terms,
    md5(array_to_string({_terms('toks')}, '|')) AS digest FROM toks""",
)
def tokens(t: Hub):
    toks = corpus_of(t).select("doc_id", retrieval.tokens(F.col("text"), STOPS).alias("toks"))
    both = toks.select("doc_id", F.size("toks").alias("n"), retrieval.terms(F.col("toks")).alias("terms"))
    return both.select(
        "doc_id",
        F.col("n").cast("bigint").alias("n_tokens"),
        F.size("terms").cast("bigint").alias("n_terms"),
        F.md5(F.array_join("terms", "|").cast("binary")).alias("digest"),
    )


@query(
    "text_index",
    with_views("tf", d="SELECT term, count(*) AS df, sum(tf) AS n FROM tf GROUP BY term")
    + """SELECT df, count(*) AS terms, CAST(sum(n) AS BIGINT) AS occurrences, sum(length(term)) AS letters FROM d GROUP BY df""",
)
def text_index_facts(t: Hub):
    """The stored postings by how many documents a term is in: they hold every term of every document once."""
    postings = index_of(t).stored("postings").filter("block IS NOT NULL")
    each = postings.select("term", "df", F.size("entries").alias("docs"), F.aggregate("entries", F.lit(0).cast("bigint"), lambda a, e: a + e["tf"]).alias("n"))
    per = each.groupBy("term").agg(F.sum("docs").alias("df"), F.sum("n").alias("n"), F.min("df").alias("_lo"), F.max("df").alias("_hi"))
    wrong = F.raise_error(F.lit("a term's stored frequency differs from its postings")).cast("bigint")
    df = F.when((F.col("_lo") == F.col("df")) & (F.col("_hi") == F.col("df")), F.col("df")).otherwise(wrong)
    return per.select(df.alias("df"), "n", F.length("term").cast("bigint").alias("l")).groupBy("df").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("n").alias("occurrences"), F.sum("l").alias("letters")
    )


@query("tfidf", with_views("docw") + "SELECT doc_id, terms, round(norm, 5) AS norm, round(mx / norm, 6) AS max_w FROM docw")
def tfidf(t: Hub):
    out = text_index.tfidf(index_of(t), query_text(t), corpus_of(t))
    return out.select("doc_id", "terms", F.round("norm", 5).alias("norm"), F.round("max_w", 6).alias("max_w"))


@query("cosine", with_views("cosine") + "SELECT doc_id, round(cos, 6) AS cos FROM cosine")
def cosine(t: Hub):
    return text_index.cosine(index_of(t), query_text(t)).withColumn("cos", F.round("cos", 6))


@query("keyword_bonus", with_views("kw") + "SELECT doc_id, round(kw, 6) AS kw FROM kw")
def keyword_bonus(t: Hub):
    return corpus_of(t).select("doc_id", F.round(retrieval.keyword_share(F.col("text"), query_text(t)), 6).alias("kw"))


@query(
    "hybrid_topk",
    with_views("best") + "SELECT doc_id, round(cos, 6) AS cos, round(kw, 6) AS kw, round(score, 6) AS score FROM best",
)
def hybrid_topk(t: Hub):
    out = text_index.hybrid_topk(index_of(t), query_text(t), 5)
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("cos", "kw", "score")])


@query(
    "report_facts",
    with_views("pvm", "anova", "best")
    + """SELECT 'metric' AS section, name AS item, round(value, 6) AS value, 1 AS needs_review FROM (
    SELECT accuracy, specificity, macro_sensitivity, macro_auc FROM pvm WHERE model = 'rf' AND protocol = 'loso')
    UNPIVOT (value FOR name IN (accuracy, specificity, macro_sensitivity, macro_auc))
    UNION ALL SELECT 'feature', feature, round(f, 6), 1 FROM (SELECT * FROM anova ORDER BY f DESC, feature LIMIT 5)
    UNION ALL SELECT 'evidence', CAST(doc_id AS VARCHAR), round(score, 6), 1 FROM best""",
)
def report_facts(t: Hub):
    """Figures, leading features and evidence in one table; every row asks for review."""
    pooled = evaluate.pooled_vs_macro(t.scored.filter("model = 'rf' AND protocol = 'loso'"))
    names = ["accuracy", "specificity", "macro_sensitivity", "macro_auc"]
    metric = pooled.select(*names).unpivot([], names, "item", "value").select(F.lit("metric").alias("section"), "item", "value")
    top = profile.rank_features(profile.anova(t.emb, FEATS, with_p=False), "f", "rank", 5)
    feature = top.select(F.lit("feature").alias("section"), F.col("feature").alias("item"), F.col("f").alias("value"))
    best = text_index.hybrid_topk(index_of(t), query_text(t), 5)
    evidence = best.select(
        F.lit("evidence").alias("section"), F.col("doc_id").cast("string").alias("item"), F.col("score").alias("value")
    )
    facts = metric.unionByName(feature).unionByName(evidence)
    return facts.select("section", "item", F.round("value", 6).alias("value"), F.lit(1).alias("needs_review"))
