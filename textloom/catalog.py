"""The core queries and the SQL each is held against."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import analysis, marks, paths, values
from textloom.functions.times import epoch_s
from textloom.operators import capture, index, maintenance, run, search, snippets
from textloom.operators.search import Options
from textloom.session import bounded_broadcast, cut, fingerprint, shared_dir, table
from textloom.sources import extract
from textloom.streaming import watch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- problem 4: processing only new or changed records

_KEY = "lower(replace(path, chr(92), '/'))"


def _p4_sql() -> str:
    """The runs one after another, each over the state the last one left."""
    fresh = """(s.size IS NOT DISTINCT FROM l.size AND s.mtime = l.mtime AND (
        s.ver = l.version
        OR s.ver = 4611686018427387904 AND l.cloud
        OR ((s.ver >> 61) & 1) = 1 AND ((s.ver >> 62) & 1) = 0
           AND ((s.ver >> 40) & 255) = (l.version & 255)
           AND l.now_s < (s.ver & 4294967295) + least(21600 * (1::BIGINT << least(greatest((s.ver >> 32) & 255, 1) - 1, 20)::INTEGER), 604800)))"""
    steps = [f"""
base AS (
  SELECT {_KEY} AS key, l.run_id, listed_at, size, coalesce(mtime_ms, 0) AS mtime, coalesce(cloud, false) AS cloud,
         coalesce(readable, false) AND coalesce(batch_no, 2147483647) <= r.batches_committed AS durable,
         lower(regexp_extract(regexp_extract({_KEY}, '[^/]*$'), '^.+\\.([^.]*)$', 1)) AS ext,
         epoch_us(r.started_at) // 1000000 AS now_s, coalesce(batch_no, 2147483647) AS batch_no
  FROM file_listing l JOIN index_runs r USING (run_id)),
latest AS (
  SELECT * FROM base QUALIFY row_number() OVER (PARTITION BY key, run_id ORDER BY listed_at DESC, batch_no DESC, size DESC, mtime DESC, cloud DESC) = 1),
log AS (
  SELECT b.*, coalesce((SELECT max(version) FROM extractor_versions v WHERE lower(v.ext) = b.ext AND v.since_run <= b.run_id), 1) AS version
  FROM latest b),
s0 AS (SELECT DISTINCT key, size, coalesce(mtime_ms, 0) AS mtime, coalesce(ver, 0) AS ver FROM files)"""]
    for n in range(1, 9):
        steps.append(f"""
d{n} AS (SELECT l.* FROM log l LEFT JOIN s{n - 1} s USING (key) WHERE l.run_id = {n} AND l.durable AND (s.key IS NULL OR NOT {fresh})),
s{n} AS (SELECT key, size, mtime, CASE WHEN cloud THEN 4611686018427387904 ELSE version END AS ver FROM d{n}
         UNION ALL SELECT s.* FROM s{n - 1} s WHERE NOT EXISTS (SELECT 1 FROM d{n} d WHERE d.key = s.key))""")
    return "WITH " + ",".join(steps) + "\n" + "\nUNION ALL ".join(f"SELECT run_id, key FROM d{n}" for n in range(1, 9))


def _job(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The place of a job in the shared folder: the same for the same tables, in every process."""
    return f"{shared_dir(spark)}/capture-{name}-{fingerprint(table(spark, sf_dir, 'file_listing'))}"


@query(_p4_sql())
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return capture.found(t("file_listing"), t("index_runs"), t("files"), t("extractor_versions"), _job(spark, sf_dir, "found"))


@query("""
SELECT l.run_id, coalesce(r.batches_committed, 0) AS durable_batch, count(*) AS entries,
       min(epoch_us(listed_at)) AS first_us, max(epoch_us(listed_at)) AS last_us
FROM file_listing l LEFT JOIN (SELECT DISTINCT run_id, batches_committed FROM index_runs) r USING (run_id)
WHERE path IS NOT NULL GROUP BY ALL""")
def p4_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The write-ahead plan: per run its sightings, first and last instant and how far it becomes durable."""
    job = capture.CaptureJob(spark, f"{_job(spark, sf_dir, 'plan')}-{uuid.uuid4().hex}")
    job.append(table(spark, sf_dir, "file_listing"))
    plan = job.planned(job.plan(table(spark, sf_dir, "index_runs"), table(spark, sf_dir, "extractor_versions")), "runs")
    return plan.select("run_id", "durable_batch", F.col("sightings").alias("entries"), "first_us", "last_us")


# ---- search; the SQL restates analysis, statistics and scores from the tables

_BASE = r"""
f AS (SELECT DISTINCT * FROM files),
c AS (SELECT DISTINCT key, content, unit_labels FROM contents),
raw AS (
  SELECT 'content' AS field, key, regexp_extract_all(content, '[\p{L}\p{N}\x{0345}\x{0363}-\x{036F}]+') AS w FROM (SELECT DISTINCT key, content FROM c) WHERE content IS NOT NULL
  UNION ALL SELECT 'name', key, regexp_extract_all(name, '[\p{L}\p{N}\x{0345}\x{0363}-\x{036F}]+') FROM f WHERE name IS NOT NULL
  UNION ALL SELECT 'folder', key, regexp_extract_all(folder, '[\p{L}\p{N}\x{0345}\x{0363}-\x{036F}]+') FROM f WHERE folder IS NOT NULL
  UNION ALL SELECT 'meta', key, regexp_extract_all(meta, '[\p{L}\p{N}\x{0345}\x{0363}-\x{036F}]+') FROM f WHERE meta IS NOT NULL),
tok AS (SELECT field, key, pos, replace(lower(t), 'ё', 'е') AS term
        FROM (SELECT field, key, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS pos FROM raw) WHERE strlen(t) < 60),
tf AS (SELECT field, key, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT field, key, count(*) AS dl FROM tok GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
st AS (SELECT field, avg(dl) AS avgdl FROM dl GROUP BY ALL),
n AS (SELECT count(*) AS n FROM f)"""
_FIELDS = {"any": ("content", "name", "meta", "folder"), "content": ("content",), "name": ("name",), "path": ("name", "folder"), "meta": ("meta",)}
_RANK = {"content": 1.0, "name": 4.0, "meta": 2.5, "folder": 1.0}
_PRE = {"content": 1.0, "name": 3.0, "meta": 2.0, "folder": 1.0}
_MIS = {"content": 1.0, "name": 3.0, "meta": 2.0}
_IDF = "ln(1 + (n.n - df.df + 0.5) / (df.df + 0.5))"


def _norm(tf: str) -> str:
    return f"{tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * dl.dl / st.avgdl))"


def _leaf(kind: str, text: str, scope: str = "any", gid: int = 0, words: tuple[str, ...] = (), distance: int = 1) -> str:
    """SQL of the matches of one clause; ``words`` are its terms, written out by hand."""
    out = []
    if kind in ("word", "phrase"):
        for fd in _FIELDS[scope]:
            if len(words) == 1:
                out.append(f"SELECT tf.key, {gid} AS gid, {_RANK[fd]} * {_IDF} * {_norm('tf.tf')} AS score FROM tf JOIN df USING (field, term) JOIN dl ON dl.field = tf.field AND dl.key = tf.key JOIN st ON st.field = tf.field, n WHERE tf.field = '{fd}' AND term = '{words[0]}'")
            elif len(words) > 1 and fd == "folder":
                inlist = ", ".join(f"'{w}'" for w in words)
                out.append(f"SELECT tf.key, {gid}, sum({_IDF} * {_norm('tf.tf')}) FROM tf JOIN df USING (field, term) JOIN dl ON dl.field = tf.field AND dl.key = tf.key JOIN st ON st.field = tf.field, n WHERE tf.field = 'folder' AND term IN ({inlist}) GROUP BY tf.key HAVING count(*) = {len(set(words))}")
            elif len(words) > 1:
                joins = " ".join(f"JOIN tok t{i} ON t{i}.field = t0.field AND t{i}.key = t0.key AND t{i}.pos = t0.pos + {i} AND t{i}.term = '{w}'" for i, w in enumerate(words) if i)
                idfs = " + ".join(f"(SELECT {_IDF} FROM df, n WHERE df.field = '{fd}' AND df.term = '{w}')" for w in words)
                out.append(f"SELECT p.key, {gid}, {_RANK[fd]} * ({idfs}) * {_norm('p.tf')} FROM (SELECT t0.key, count(*) AS tf FROM tok t0 {joins} WHERE t0.field = '{fd}' AND t0.term = '{words[0]}' GROUP BY t0.key) p JOIN dl ON dl.field = '{fd}' AND dl.key = p.key JOIN st ON st.field = '{fd}'")
        if kind == "word" and scope in ("any", "name") and len(text) >= 2:
            out.append(f"SELECT key, {gid}, 3.0 FROM f WHERE contains(name_lc, '{text.lower()}')")
    elif kind == "prefix":
        p = text.lower().replace("ё", "е")
        out += [f"SELECT DISTINCT key, {gid}, {_PRE[fd]} FROM tf WHERE field = '{fd}' AND starts_with(term, '{p}')" for fd in _FIELDS[scope]]
        if scope in ("any", "name"):
            out.append(f"SELECT key, {gid}, 2.0 FROM f WHERE starts_with(name_lc, '{p}')")
    else:
        out += [f"SELECT DISTINCT key, {gid}, {_MIS[fd]} FROM tf WHERE field = '{fd}' AND damerau_levenshtein(term, '{words[0]}') <= {distance}" for fd in _FIELDS[scope] if fd in _MIS]
    return "\nUNION ALL ".join(out)


def _matched(groups: list[str], negatives: list[str] = (), where: str = "true") -> str:
    """WITH clauses that end in m(key, score): records in every group, in no negative, and under the filter."""
    leaves = "\nUNION ALL ".join(groups) if groups else "SELECT key, 0 AS gid, 1.0 AS score FROM f"
    minus = " ".join(f"AND key NOT IN (SELECT key FROM ({n}))" for n in negatives)
    return f"""WITH {_BASE},
leaf(key, gid, score) AS ({leaves}),
m AS (SELECT key, sum(score) AS score FROM leaf WHERE key IN (SELECT key FROM f WHERE {where}) {minus} GROUP BY key HAVING count(DISTINCT gid) = {max(1, len(groups))})"""


_SET = " SELECT key, round(score, 4) AS score FROM m"


def _page(order: str, limit: int = 20, offset: int = 0, score: str = "round(score, 4)") -> str:
    return f" SELECT key, {score} AS score FROM m JOIN f USING (key) ORDER BY {order}, key LIMIT {limit} OFFSET {offset}"


def _ix(spark: SparkSession, sf_dir: str, stem: bool = False) -> index.Index:
    return index.opened(spark, sf_dir, stem)


def _found(name: str, o: Options, sql: str, doc: str) -> None:
    """A query over everything that matches."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.matches(_ix(spark, sf_dir), o)[0].select("key", F.round("score", 4).alias("score"))

    run.__name__, run.__doc__ = name, doc
    query(sql)(run)


def _top(name: str, o: Options, sql: str, doc: str) -> None:
    """A query for one page, for which the limit is the feature."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.search(_ix(spark, sf_dir), o).select("key", F.round(F.col("score").cast("double"), 4).alias("score"))

    run.__name__, run.__doc__ = name, doc
    query(sql)(run)


_W = {"смету": ("смету",), "приказ": ("приказ",), "договор": ("договор",), "contract": ("contract",), "register": ("register",), "отчёт": ("отчет",)}


def _word(text: str, scope: str = "any", gid: int = 0) -> str:
    return _leaf("word", text, scope, gid, _W[text])


_found("search_single_term", Options("смету"), _matched([_word("смету")]) + _SET, "One word in every field, and as part of a name.")
_found("search_fold", Options("отчёт"), _matched([_word("отчёт")]) + _SET, "ё is searched as е in texts and as itself in names.")
_found("search_and", Options("смету приказ"), _matched([_word("смету"), _word("приказ", gid=1)]) + _SET, "All words are required.")
_found("search_plus", Options("+смету +приказ"), _matched([_word("смету"), _word("приказ", gid=1)]) + _SET, "A plus says what holds anyway.")
_found("search_or_bars", Options("смету || contract"), _matched([_word("смету") + "\nUNION ALL " + _word("contract")]) + _SET, "Bars are OR.")
_found("search_or_first", Options("OR смету приказ"), _matched([_word("смету"), _word("приказ", gid=1)]) + _SET, "OR before any group is ignored.")
_found("search_bang", Options("смету !приказ NOT contract"), _matched([_word("смету")], [_word("приказ"), _word("contract")]) + _SET, "All ways to exclude.")
_found("search_or_group", Options("смету OR contract приказ"), _matched([_word("смету") + "\nUNION ALL " + _word("contract"), _word("приказ", gid=1)]) + _SET, "Alternatives within a group.")
_found("search_not", Options("смету -приказ"), _matched([_word("смету")], [_word("приказ")]) + _SET, "Exclusion.")
_found("search_only_negative", Options("-смету"), _matched([], [_word("смету")]) + _SET, "Everything but.")
_found("search_match_all", Options(""), _matched([]) + _SET, "No clause: everything.")
_found("search_phrase", Options('"акт приёмки"'), _matched([_leaf("phrase", "", "any", 0, ("акт", "приемки"))]) + _SET, "Words one after another.")
_found("search_phrase_long", Options('content:"the list of defects"'), _matched([_leaf("phrase", "", "content", 0, ("the", "list", "of", "defects"))]) + _SET, "A longer phrase in contents.")
_found("search_implicit_phrase", Options("счёт-фактуру"), _matched([_leaf("word", "счёт-фактуру", "any", 0, ("счет", "фактуру"))]) + _SET, "A word of several tokens is a phrase.")
_found("search_prefix", Options("регистр*"), _matched([_leaf("prefix", "регистр")]) + _SET, "Beginnings of terms and of names.")
_found("search_fuzzy_1", Options("regsiter~"), _matched([_leaf("fuzzy", "", "any", 0, ("regsiter",), 1)]) + _SET, "One edit, a swap counting one.")
_found("search_fuzzy_2", Options("contratc~2"), _matched([_leaf("fuzzy", "", "any", 0, ("contratc",), 2)]) + _SET, "Two edits.")
_found("search_fuzzy_clamped", Options("contratc~7"), _matched([_leaf("fuzzy", "", "any", 0, ("contratc",), 2)]) + _SET, "More than two edits are two.")
_found("search_quotes", Options("«list of defects» “register”"), _matched([_leaf("phrase", "", "any", 0, ("list", "of", "defects")), _leaf("phrase", "", "any", 1, ("register",))]) + _SET, "Every kind of quotation mark makes a phrase, of one word too.")
_found("search_name_substring", Options("name:кино"), _matched([_leaf("word", "кино", "name", 0, ("кино",))]) + _SET, "Part of a name.")
_found("search_name_prefix", Options("name:смет*"), _matched([_leaf("prefix", "смет", "name")]) + _SET, "Beginning of a name.")
_found("search_path_bag", Options('path:"отделы документы"'), _matched([_leaf("phrase", "", "path", 0, ("отделы", "документы"))]) + _SET, "Folder words in any order.")
_found("mode_name", Options("contract", mode="name"), _matched([_word("contract", "name")]) + _SET, "Names only.")
_found("mode_content", Options("contract", mode="content"), _matched([_word("contract", "content")]) + _SET, "Contents only.")
_found("scope_meta", Options("meta:автор"), _matched([_leaf("word", "автор", "meta", 0, ("автор",))]) + _SET, "Properties only.")
_found("filter_ext", Options("смету ext:docx,.PDF"), _matched([_word("смету")], where="ext IN ('docx', 'pdf')") + _SET, "Types in the query.")
_found("filter_ext_union", Options("смету ext:docx", exts=["pdf"]), _matched([_word("смету")], where="ext IN ('docx', 'pdf')") + _SET, "Types of query and options are joined.")
_found("filter_dir", Options("смету", dirs=["D:\\Архив\\"]), _matched([_word("смету")], where="starts_with(key, 'd:/архив/')") + _SET, "A folder and all below.")
_found("filter_size", Options("", min_size=10_000, max_size=100_000), _matched([], where="size BETWEEN 10000 AND 100000") + _SET, "Both ends included.")
_found("filter_mtime", Options("смету", after_ms=1_650_000_000_000, before_ms=1_700_000_000_000), _matched([_word("смету")], where="mtime_ms BETWEEN 1650000000000 AND 1700000000000") + _SET, "Modified between.")
_top("search_bm25_topk", Options("register contract"), _matched([_word("register"), _word("contract", gid=1)]) + _page("round(score, 6) DESC"), "The best twenty.")
_top("page_2", Options("смету", offset=20), _matched([_word("смету")]) + _page("round(score, 6) DESC", offset=20), "The next page.")
for _s, _o in (("newest", "coalesce(mtime_ms, 0) DESC"), ("oldest", "coalesce(mtime_ms, 0)"), ("largest", "coalesce(size, 0) DESC"), ("smallest", "coalesce(size, 0)")):
    _top(f"sort_{_s}", Options("смету", sort=_s), _matched([_word("смету")]) + _page(_o, score="0.0::DOUBLE"), f"{_s.capitalize()} first.")
_top("sort_default_newest", Options(""), _matched([]) + _page("coalesce(mtime_ms, 0) DESC", score="0.0::DOUBLE"), "Nothing asked for: newest first.")


@query(_matched([_word("смету")]) + " SELECT count(*) AS total FROM m")
def search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.count(_ix(spark, sf_dir), Options("смету", snippets=False))


_GROUPS = list(values.TYPE_GROUPS.values())


@query(_matched([_word("смету")]) + " SELECT grp, count_if(list_contains(exts, ext)) AS hits FROM (VALUES " + ", ".join(f"({i}, {g!r})" for i, g in enumerate(_GROUPS)) + ") g(grp, exts), m JOIN f USING (key) GROUP BY grp")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.facets(_ix(spark, sf_dir), Options("смету"), _GROUPS)


@query("SELECT coalesce(ext, '') AS value, count(*) AS documents FROM (SELECT DISTINCT * FROM files) GROUP BY 1")
def stats_by_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.by_value(_ix(spark, sf_dir), "ext")


@query("SELECT coalesce(status, '') AS value, count(*) AS documents FROM (SELECT DISTINCT * FROM files) GROUP BY 1")
def stats_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.by_value(_ix(spark, sf_dir), "status")


@query("SELECT key FROM (SELECT DISTINCT * FROM files) WHERE key = 'd:/архив/отчёты' OR starts_with(key, 'd:/архив/отчёты/')")
def below_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.below(_ix(spark, sf_dir), "d:/архив/отчёты").select("key")


@query(f"WITH {_BASE} SELECT field, term, df.df, sum(tf.tf) AS cf FROM df JOIN tf USING (field, term) GROUP BY ALL")
def term_stats_df_cf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ix(spark, sf_dir).vocabulary.select("field", "term", "df", "cf")


@query(f"WITH {_BASE} SELECT field, count(*) AS docs, round(avg(dl), 6) AS avgdl FROM dl GROUP BY field")
def field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = _ix(spark, sf_dir)
    return spark.createDataFrame([(f, d, round(a, 6)) for f, (d, a) in ix.stats.items()], "field string, docs long, avgdl double")


@query(r"""SELECT term, count(*) AS cf FROM (SELECT replace(lower(t), 'ё', 'е') AS term FROM (
SELECT unnest(regexp_extract_all(content, '[\p{L}\p{N}\x{0345}\x{0363}-\x{036F}]+')) AS t FROM contents) WHERE strlen(t) < 60) GROUP BY term""")
def tokenize_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis as a column expression: counts of all terms of all contents."""
    return table(spark, sf_dir, "contents").select(F.explode(analysis.tokens(F.col("content"))).alias("term")).groupBy("term").agg(F.count("*").alias("cf"))


_BATCH = ["смету приказ", "contract register", "журнал", "the list of defects"]


@query(f"""WITH {_BASE}, q(qid, terms) AS (VALUES (0, ['смету', 'приказ']), (1, ['contract', 'register']), (2, ['журнал']), (3, ['the', 'list', 'of', 'defects'])),
e AS (SELECT qid, len(terms) AS need, unnest(terms) AS term FROM q),
h AS (SELECT qid, tf.key, need, count(*) AS k, sum({_IDF} * {_norm('tf.tf')}) AS score FROM e JOIN tf ON tf.term = e.term AND tf.field = 'content' JOIN df ON df.term = tf.term AND df.field = 'content' JOIN dl ON dl.key = tf.key AND dl.field = 'content' JOIN st ON st.field = 'content', n GROUP BY ALL)
SELECT qid, key, round(score, 4) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, key) AS rank FROM h WHERE k = need QUALIFY rank <= 10""")
def search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of queries answered by one join."""
    asked = spark.createDataFrame(list(enumerate(_BATCH)), "qid int, text string")
    return search.many(_ix(spark, sf_dir), asked).withColumn("score", F.round("score", 4))


def _stemmed(sql: str, stem: str, endings: str) -> str:
    """The SQL over terms in which the forms of one word are its stem, as the stemmed index has them; other words keep their
    forms, which changes no count this query reads."""
    forms = f"CASE WHEN regexp_full_match(lower(t), '{stem}({endings})?') THEN '{stem}' ELSE replace(lower(t), 'ё', 'е') END AS term"
    return sql.replace("replace(lower(t), 'ё', 'е') AS term", forms)


@query(_stemmed(_matched([_leaf("word", "договорами", "any", 0, ("договор",))]) + _SET, "договор", "а|у|ом|е|ы|ов|ам|ами|ах"))
def stem_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other forms of a word are found through its stem."""
    return search.matches(_ix(spark, sf_dir, True), Options("договорами"))[0].select("key", F.round("score", 4).alias("score"))


@query(_stemmed(_matched([_leaf("word", "регистрацию", "content", 0, ("регистрац",))]) + _page("round(score, 6) DESC"), "регистрац", "ия|ии|ию|ией|ий|иям|иями|иях"))
def stem_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best twenty contents by a stem."""
    return search.search(_ix(spark, sf_dir, True), Options("content:регистрацию")).select("key", F.round(F.col("score").cast("double"), 4).alias("score"))


@query()
def snippet_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page with fragments, marks and units."""
    return snippets.hits(_ix(spark, sf_dir, True), Options("реестр платежей"))


# ---- units and viewer


@query("""WITH u AS (SELECT key, unit_labels, string_split(content, chr(12)) AS p FROM contents WHERE content IS NOT NULL)
SELECT key, unit_no, CASE WHEN unit_no < len(unit_labels) THEN unit_labels[unit_no + 1] END AS label, text
FROM (SELECT key, unit_labels, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS unit_no FROM u)""")
def unit_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippets.units(table(spark, sf_dir, "contents"))


@query("""SELECT key, CASE WHEN k < len(unit_labels) THEN unit_labels[k + 1] END AS location FROM (
SELECT key, unit_labels, len(string_split(substring(content, 1, instr(lower(content), 'смету')), chr(12))) - 1 AS k FROM contents WHERE instr(lower(content), 'смету') > 0)""")
def unit_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippets.location(table(spark, sf_dir, "contents"), "смету")


@query(r"""WITH l AS (SELECT key, line, line_no, contains(lower(line), 'смету')::INT + contains(lower(line), 'приказ')::INT + contains(lower(line), 'журнал')::INT AS n FROM (
  SELECT key, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS line_no FROM (SELECT DISTINCT key, string_split(content, chr(10)) AS p FROM contents WHERE content IS NOT NULL)))
SELECT key, line_no, left(line, 2000) AS line FROM l WHERE n > 0 QUALIFY n = max(n) OVER (PARTITION BY key)""")
def viewer_match_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippets.match_lines(table(spark, sf_dir, "contents").select("key", "content").distinct(), ["смету", "приказ", "журнал"])


@query("SELECT key, CASE WHEN strlen(lower(content)) = strlen(content) THEN len(regexp_extract_all(lower(content), 'смету|приказ|register')) ELSE 0 END AS marks FROM (SELECT DISTINCT key, content FROM contents WHERE content IS NOT NULL)")
def viewer_mark_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many places a viewer marks in each text; none where lower case changes the length."""
    marks_of = F.pandas_udf(lambda s: s.map(lambda t: len(snippets.viewer_marks(t, ["смету", "приказ", "register"]))), "long")
    return table(spark, sf_dir, "contents").where("content is not null").select("key", "content").distinct().select("key", marks_of("content").alias("marks"))


@query("SELECT DISTINCT folder, EXISTS (SELECT 1 FROM files g WHERE g.key = lower(replace(f.folder, chr(92), '/')) || '/none.txt') AS stored FROM files f WHERE folder IS NOT NULL")
def paths_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether paths are in the index, for one path of every folder."""
    asked = table(spark, sf_dir, "files").where("folder is not null").select("folder").distinct().withColumn("key", F.concat(paths.path_key(F.col("folder")), F.lit("/none.txt")))
    return asked.join(search.stored(_ix(spark, sf_dir), asked), "key", "left").select("folder", F.coalesce("stored", F.lit(False)).alias("stored"))


# ---- maintenance

_LAST = f"""(SELECT l.*, coalesce((SELECT max(version) FROM extractor_versions x WHERE lower(x.ext) = lower(regexp_extract(regexp_extract(l.key, '[^/]*$'), '^.+\\.([^.]*)$', 1)) AND x.since_run <= l.run_id), 1) AS version, (SELECT epoch_us(started_at) // 1000000 FROM index_runs r WHERE r.run_id = l.run_id) AS now_s
FROM (SELECT {_KEY} AS key, run_id, size, coalesce(mtime_ms, 0) AS mtime_ms, coalesce(cloud, false) AS cloud, coalesce(readable, true) AS readable FROM file_listing WHERE run_id = (SELECT max(run_id) FROM index_runs) AND path IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY listed_at DESC, size DESC, mtime_ms DESC NULLS LAST, cloud DESC, readable DESC) = 1) l)"""
_ACTIONS = f"""
l AS {_LAST},
o AS (SELECT DISTINCT key, size AS s, coalesce(mtime_ms, 0) AS m, coalesce(ver, 0) AS v FROM files),
a AS (SELECT coalesce(l.key, o.key) AS key, CASE
  WHEN l.key IS NULL THEN 'vanished' WHEN NOT readable THEN 'unreadable' WHEN o.key IS NULL THEN 'new'
  WHEN size IS DISTINCT FROM s OR mtime_ms <> m THEN 'changed'
  WHEN v = l.version THEN 'unchanged'
  WHEN v = 4611686018427387904 THEN CASE WHEN cloud THEN 'unchanged' ELSE 'stale' END
  WHEN ((v >> 61) & 1) = 1 AND ((v >> 40) & 255) = (l.version & 255) AND now_s < (v & 4294967295) + least(21600 * (1::BIGINT << least(greatest((v >> 32) & 255, 1) - 1, 20)::INTEGER), 604800) THEN 'deferred'
  ELSE 'stale' END AS action FROM l FULL JOIN o ON l.key = o.key)"""


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last run's listing against the stored records, with the versions in force then and its start as the present time."""
    t = lambda n: table(spark, sf_dir, n)
    last = t("index_runs").orderBy(F.desc("run_id")).select("run_id", epoch_s("started_at").alias("now_s")).first()
    seen = t("file_listing").where((F.col("run_id") == last["run_id"]) & F.col("path").isNotNull()).withColumn("key", paths.path_key(F.col("path")))
    best = F.max(F.struct(*(F.col(c) for c in ("listed_at", "size", "mtime_ms", "cloud", "readable")))).alias("r")
    force = capture.versions_in_force(t("extractor_versions"), t("index_runs")).where(F.col("run_id") == last["run_id"]).select("ext", F.col("version").cast("long").alias("v"))
    listing = seen.groupBy("key").agg(best).select("key", "r.*").withColumn("ext", paths.extension(F.col("key"))).join(bounded_broadcast(force), "ext", "left")
    return maintenance.classify(listing, t("files").select("key", "size", "mtime_ms", "ver").distinct(), F.coalesce("v", F.lit(1).cast("long")), F.lit(last["now_s"]).cast("long"))


@query(f"WITH {_ACTIONS} SELECT key, action FROM a")
def incremental_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last run makes of every file and record."""
    return _actions(spark, sf_dir)


@query(f"WITH {_ACTIONS} SELECT key FROM a WHERE action = 'vanished' AND NOT starts_with(key, 'd:/архив/')")
def incremental_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vanished records, but for those below a folder that could not be read."""
    return maintenance.removed(_actions(spark, sf_dir), spark.createDataFrame([("d:/архив",)], "prefix string"))


@query(f"WITH {_ACTIONS} SELECT count_if(action <> 'vanished') AS scanned, count_if(action = 'unchanged') AS unchanged, count_if(action IN ('new', 'changed', 'stale')) AS indexed, count_if(action = 'vanished') AS removed, count_if(action = 'deferred') AS deferred FROM a")
def incremental_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.summary(_actions(spark, sf_dir))


def _after_runs_sql() -> str:
    """The records after all runs: listed by the run and readable, or listed and there before; terms of their names, folders and texts."""
    steps = [f"""WITH seen AS (SELECT run_id, {_KEY} AS key, coalesce(readable, true) AS readable FROM file_listing WHERE path IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY run_id, {_KEY} ORDER BY listed_at DESC, size DESC, mtime_ms DESC NULLS LAST, cloud DESC, readable DESC) = 1),
l0 AS (SELECT DISTINCT key FROM files WHERE key IS NOT NULL)"""]
    for n in range(1, 9):
        steps.append(f"l{n} AS (SELECT key FROM seen s WHERE run_id = {n} AND (readable OR EXISTS (SELECT 1 FROM l{n - 1} p WHERE p.key = s.key)))")
    w = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}\x{{0345}}\x{{0363}}-\x{{036F}}]+')"
    file = "regexp_extract(key, '[^/]*$')"
    name = f"CASE WHEN regexp_extract({file}, '^(.+)\\.[^.]*$', 1) = '' THEN {file} ELSE regexp_extract({file}, '^(.+)\\.[^.]*$', 1) END"
    steps.append(f"""
t AS (SELECT 'name' AS field, key, {w.format(name)} AS w FROM l8
  UNION ALL SELECT 'folder', key, {w.format("regexp_extract(key, '^(.*)/[^/]*$', 1)")} FROM l8
  UNION ALL SELECT 'content', key, {w.format("content")} FROM (SELECT DISTINCT key, content FROM contents WHERE content IS NOT NULL) SEMI JOIN l8 USING (key)),
k AS (SELECT field, key, replace(lower(x), 'ё', 'е') AS term FROM (SELECT field, key, unnest(w) AS x FROM t) WHERE strlen(x) < 60)""")
    return ", ".join(steps) + " SELECT field, term, count(DISTINCT key) AS df, count(*) AS cf FROM k GROUP BY field, term"


@query(_after_runs_sql())
def index_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index brought up to date by all runs of the listing, a commit each: its terms and counts. Texts come from contents."""
    t = lambda n: table(spark, sf_dir, n)
    runs = {r["run_id"]: r["now_s"] for r in t("index_runs").select("run_id", epoch_s("started_at").alias("now_s")).collect()}  # a parameter table
    texts = t("contents").select("key", "content", "unit_labels").groupBy("key").agg(F.max(F.struct("content", "unit_labels")).alias("c")).select("key", "c.*")

    def load(todo: DataFrame) -> DataFrame:
        return todo.join(texts, "key", "left").withColumns({"meta": F.lit(None).cast("string"), "status": F.lit("ok"), "truncated": F.lit(False)})

    path = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    p = F.col("key")
    stored = t("files").where("key is not null").groupBy("key").agg(F.max(F.struct("mtime_ms", "size", "ver")).alias("r")).select("key", "r.*")
    first = maintenance.build_record(stored.withColumn("path", p)).join(texts, "key", "left").withColumns({"meta": F.lit(None).cast("string"), "status": F.lit("ok")})
    ix = index.rebuilt(spark, first.select(*run.ATTRIBUTES), path, False)
    best = F.max(F.struct("listed_at", "size", "mtime_ms", "cloud", F.coalesce("readable", F.lit(True)).alias("readable"), "path")).alias("r")
    seen = t("file_listing").where("path is not null").groupBy("run_id", paths.path_key(F.col("path")).alias("key")).agg(best).select("run_id", "r.*")
    seen = cut(seen.withColumn("path", paths.path_key(F.col("path"))), "seen")
    force = cut(capture.versions_in_force(t("extractor_versions"), t("index_runs")), "versions")
    for n in sorted(runs):
        version = F.lit(1).cast("long")
        for r in force.where(F.col("run_id") == n).collect():  # one row per extension
            version = F.when(F.col("ext") == r["ext"], r["version"]).otherwise(version)
        ix, _ = run.maintain(ix, seen.where(F.col("run_id") == n), load, version, runs[n])
    return ix.vocabulary.select("field", "term", "df", "cf")


@query("SELECT count_if(h = 'ok') AS ok, count_if(h = 'empty') AS empty, count_if(h = 'encrypted') AS encrypted, count_if(h = 'skipped') AS skipped, count_if(h = 'scan') AS scans, count_if(h = 'ocr') AS recognized, count_if(h = 'error') AS failed FROM (SELECT split_part(status, ':', 1) AS h FROM extracted)")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.status_counts(table(spark, sf_dir, "extracted"))


_SAMPLE_TIME = 1741406400


@query(f"""SELECT DISTINCT key, version, cloud, CASE WHEN v = version THEN 'fresh' WHEN v = 4611686018427387904 AND cloud THEN 'fresh'
  WHEN ((v >> 61) & 1) = 1 AND ((v >> 62) & 1) = 0 AND ((v >> 40) & 255) = (version & 255) AND {_SAMPLE_TIME} < (v & 4294967295) + least(21600 * (1::BIGINT << least(greatest((v >> 32) & 255, 1) - 1, 20)::INTEGER), 604800) THEN 'deferred' ELSE 'stale' END AS verdict
FROM (SELECT key, coalesce(ver, 0) AS v FROM files), (VALUES (1::BIGINT), (2), (3)) x(version), (VALUES (true), (false)) y(cloud)""")
def freshness_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mark of every record asks for, under three versions of extraction, as a stub and not."""
    cases = F.explode(F.array(*(F.struct(F.lit(v).cast("long").alias("version"), F.lit(c).alias("cloud")) for v in (1, 2, 3) for c in (True, False)))).alias("c")
    rows = table(spark, sf_dir, "files").select("key", F.coalesce("ver", F.lit(0).cast("long")).alias("v"), cases).select("key", "v", "c.*")
    return rows.select("key", "version", "cloud", marks.verdict(F.col("v"), F.col("version"), F.col("cloud"), F.lit(_SAMPLE_TIME).cast("long")).alias("verdict")).distinct()


@query("SELECT DISTINCT key, CASE WHEN ((ver >> 61) & 1) = 1 AND ((ver >> 62) & 1) = 0 THEN (ver >> 32) & 255 ELSE 0 END AS attempts, CASE WHEN ((ver >> 61) & 1) = 1 AND ((ver >> 62) & 1) = 0 THEN (ver & 4294967295) + least(21600 * (1::BIGINT << least(greatest((ver >> 32) & 255, 1) - 1, 20)::INTEGER), 604800) END AS due FROM files")
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = marks.unpacked(F.col("ver"))
    return table(spark, sf_dir, "files").select("key", m["failures"].alias("attempts"), F.when(m["failed"], m["due"]).alias("due")).distinct()


@query("""SELECT key, CASE WHEN k % 3 = 0 THEN 4611686018427387904 WHEN k % 3 = 1 THEN 2305843009213693952 | (2::BIGINT << 40) | (least(CASE WHEN ((ver >> 61) & 1) = 1 AND ((ver >> 62) & 1) = 0 THEN (ver >> 32) & 255 ELSE 0 END + 1, 255) << 32) | 1741406400 ELSE 2 END AS mark
FROM (SELECT DISTINCT key, coalesce(ver, 0) AS ver, length(key) AS k FROM files)""")
def version_mark_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.length("key") % 3
    mark = marks.packed(F.lit(2), k == 0, k == 1, F.col("ver"), F.lit(1741406400))
    return table(spark, sf_dir, "files").select("key", mark.alias("mark")).distinct()


@query(f"""SELECT key, commit_id, size FROM (SELECT {_KEY} AS key, run_id AS commit_id, size, NOT coalesce(readable, false) AS deleted FROM file_listing
QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY run_id DESC, (NOT coalesce(readable, false)) DESC, size DESC NULLS LAST) = 1) WHERE NOT deleted""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after all commits: last row per key, deletions gone."""
    commits = table(spark, sf_dir, "file_listing").select(paths.path_key(F.col("path")).alias("key"), F.col("run_id").alias("commit_id"), (~F.coalesce("readable", F.lit(False))).alias("deleted"), "size")
    return maintenance.latest(commits).select("key", "commit_id", "size")


@query("SELECT DISTINCT key, 9 AS commit_id, true AS deleted FROM files WHERE key = 'e:/проекты' OR starts_with(key, 'e:/проекты/')")
def delete_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.delete_path(table(spark, sf_dir, "files").select("key").distinct(), "e:/проекты", 9)


@query(r"""SELECT path, regexp_matches(p, '(^|/)(\$recycle\.bin|system volume information|\.git|\.svn|\.hg|node_modules|__pycache__)/') OR regexp_matches(p, '/(thumbs\.db|desktop\.ini|\.ds_store)$') OR regexp_matches(p, '/(~\$|\.~lock\.)[^/]*$') OR regexp_matches(p, '(?s)/[^/]*копия[^/]*$') OR regexp_matches(p, '(?s)/2019/.*\.pdf$') AS excluded
FROM (SELECT DISTINCT path, lower(replace(path, chr(92), '/')) AS p FROM file_listing)""")
def exclusion_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "file_listing").select("path").distinct().select("path", maintenance.excluded(F.col("path"), ["*копия*", "*/2019/*.pdf"]).alias("excluded"))


@query("""WITH r AS (SELECT DISTINCT regexp_replace(lower(replace(folder, chr(92), '/')), '/+$', '') AS key, folder FROM file_listing), k AS (SELECT key, min(folder) AS root FROM r GROUP BY key)
SELECT root FROM k WHERE NOT EXISTS (SELECT 1 FROM k o WHERE starts_with(k.key, o.key || '/'))""")
def nested_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.usable_roots(table(spark, sf_dir, "file_listing").select(F.col("folder").alias("root")).distinct())


@query(f"""SELECT DISTINCT {_KEY} AS key, regexp_extract(replace(path, chr(92), '/'), '[^/]*$') AS file, lower(regexp_extract(regexp_extract(replace(path, chr(92), '/'), '[^/]*$'), '^.+\\.([^.]*)$', 1)) AS ext, regexp_extract(path, '^(.*)[\\\\/][^\\\\/]*$', 1) AS folder FROM file_listing""")
def record_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return table(spark, sf_dir, "file_listing").select(paths.path_key(p).alias("key"), paths.file_name(p).alias("file"), paths.extension(p).alias("ext"), paths.folder(p).alias("folder")).distinct()


# ---- change feed

_EVENTS = f"e AS (SELECT DISTINCT {_KEY} AS key, epoch_us(ts) // 1000 AS ts_ms, coalesce(op, 'unknown') IN ('create', 'rename', 'unknown') AND coalesce(introduces_path, true) AS tree FROM change_event WHERE path IS NOT NULL AND ts IS NOT NULL)"


@query(f"""WITH {_EVENTS}, g AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER w < 1500 THEN 0 ELSE 1 END AS s FROM e WINDOW w AS (PARTITION BY key ORDER BY ts_ms)),
r AS (SELECT *, sum(s) OVER (PARTITION BY key ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT key, min(ts_ms) AS first_ms, max(ts_ms) + 1500 AS due_ms, count(*) AS events, bool_or(tree) AS tree FROM r GROUP BY key, run""")
def debounce_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.debounced(table(spark, sf_dir, "change_event"))


@query(f"""WITH RECURSIVE {_EVENTS}, g AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER w < 1500 THEN 0 ELSE 1 END AS s FROM e WINDOW w AS (PARTITION BY key ORDER BY ts_ms)),
r AS (SELECT *, sum(s) OVER (PARTITION BY key ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS run FROM g),
d AS (SELECT key, max(ts_ms) + 1500 AS due, row_number() OVER (PARTITION BY key ORDER BY max(ts_ms)) AS k FROM r GROUP BY key, run),
f(key, k, at_ms, own) AS (SELECT key, k, due, true FROM d WHERE k = 1
  UNION ALL SELECT d.key, d.k, CASE WHEN d.due <= f.at_ms THEN f.at_ms ELSE greatest(d.due, f.at_ms + 30000) END, d.due > f.at_ms FROM f JOIN d ON d.key = f.key AND d.k = f.k + 1)
SELECT key, at_ms FROM f WHERE own""")
def throttle_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.throttled(table(spark, sf_dir, "change_event"))


@query("SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, coalesce(op, 'unknown') AS op, count(*) AS events FROM change_event WHERE ts IS NOT NULL GROUP BY ALL")
def change_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.windowed_counts(table(spark, sf_dir, "change_event")).select(F.col("start").cast("timestamp_ntz").alias("start"), "op", "events")


# ---- extraction


_WHITE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(rf"SELECT key, text, CASE WHEN text = '' THEN 'empty' ELSE 'ok' END AS status FROM (SELECT key, regexp_replace(replace(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(12), ' '), '{_WHITE}$', '') AS text FROM (SELECT DISTINCT key, content FROM contents WHERE content <> ''))")
def extract_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as bytes of files come back as they were."""
    files = table(spark, sf_dir, "contents").where("content <> ''").select("key", "content").distinct().select("key", F.encode("content", "utf-8").alias("content"), F.lit("txt").alias("ext"))
    return extract.extracted(files).select("key", "text", "status")


@query(rf"SELECT key, 'Title' || chr(10) || trim(regexp_replace(content, '{_WHITE}', ' ', 'g')) AS text FROM (SELECT DISTINCT key, content FROM contents WHERE trim(regexp_replace(content, '{_WHITE}', ' ', 'g')) <> '')")
def extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts wrapped in HTML with entities, a script, a style and a comment come back in one line below the title."""
    texts = table(spark, sf_dir, "contents").select("key", "content").distinct().where(F.length(F.trim(F.regexp_replace("content", r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " "))) > 0)
    safe = F.replace(F.replace(F.replace("content", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<html><head><title>Title</title><style>p {}</style></head><body><!-- not this --><script>nor(this)</script><p>"), safe, F.lit("</p></body></html>"))
    return extract.extracted(texts.select("key", F.encode(page, "utf-8").alias("content"), F.lit("html").alias("ext"))).select("key", "text")


# ---- values


@query("""SELECT DISTINCT l_shipdate::DATE AS day, strftime(l_shipdate, '%d.%m.%Y %Y-%m-%d') AS text FROM lineitem""")
def excel_serial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    return table(spark, sf_dir, "lineitem").select(day.alias("day"), values.serial_text_column(F.datediff(day, F.expr("date'1899-12-30'")).cast("double")).alias("text")).distinct()


@query("SELECT DISTINCT p_size, p_size * 1024 AS k, p_size * 1048576 + 524288 AS m FROM part")
def parse_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size").cast("string")
    return table(spark, sf_dir, "part").select("p_size", values.size_bytes(F.concat(s, F.lit("K"))).cast("int").alias("k"), values.size_bytes(F.concat(s, F.lit(",5 MB"))).cast("int").alias("m")).distinct()


@query(r"""SELECT name_lc, row_number() OVER (ORDER BY regexp_replace(name_lc, CASE WHEN regexp_matches(name_lc, '\d+(?:\.[^.]*)?$') THEN '\d+(?:\.[^.]*)?$' ELSE '$^' END, ''), coalesce(try_cast(nullif(regexp_extract(name_lc, '(\d+)(?:\.[^.]*)?$', 1), '') AS DECIMAL(38, 0)), 0), name_lc) AS pos
FROM (SELECT DISTINCT name_lc FROM files WHERE name_lc IS NOT NULL)""")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names in the order of their trailing numbers. The number of each place comes from counts per key range."""
    return values.natural_positions(table(spark, sf_dir, "files"), "name_lc")


@query(r"SELECT key, length(regexp_replace(content, '[^\p{L}\p{Nl}]', '', 'g')) AS letters, length(regexp_replace(content, '[^\p{L}\p{Nl}]', '', 'g')) < 20 * len(string_split(content, chr(12))) AS thin FROM (SELECT DISTINCT key, content FROM contents WHERE content IS NOT NULL)")
def thin_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with fewer than twenty letters a page, which a scan would leave."""
    n = values.letters(F.col("content"))
    return table(spark, sf_dir, "contents").where("content is not null").select("key", "content").distinct().select("key", n.alias("letters"), (n < 20 * F.size(F.split("content", "\f"))).alias("thin"))
