"""Queries over the test tables for the core operators, and SQL to hold them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths, text, urls
from .operators import catalog, chunking, fusion, lexical, snapshots, vector
from .session import spread, table
from .sources import files as special

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_P1 = """
with r as (
  select snapshot_no, lower(trim(repository_identifier)) rid, '' as file_path, delivered_at,
         coalesce(repository_url, chr(1)) || '|' || coalesce(total_files::varchar, chr(1)) || '|' || coalesce(total_chunks::varchar, chr(1)) || '|' || coalesce(lower(last_commit_hash), chr(1)) v, 'r' k
  from repository_snapshots
  union all
  select snapshot_no, lower(trim(repository_identifier)), file_path, delivered_at,
         coalesce(file_type, chr(1)) || '|' || coalesce(file_size::varchar, chr(1)) || '|' || coalesce(line_count::varchar, chr(1)) || '|' || coalesce(lower(content_hash), chr(1)), 'f'
  from file_snapshots),
l as (select * from (select *, row_number() over (partition by k, snapshot_no, rid, file_path order by delivered_at desc) n from r) where n = 1),
s as (select k, snapshot_no, lag(snapshot_no) over (partition by k order by snapshot_no) prev from (select distinct k, snapshot_no from l)),
a as (select s.k, s.snapshot_no, l.rid, l.file_path, l.v from s join l on l.k = s.k and l.snapshot_no = s.snapshot_no where prev is not null),
b as (select s.k, s.snapshot_no, l.rid, l.file_path, l.v from s join l on l.k = s.k and l.snapshot_no = s.prev)
select coalesce(a.snapshot_no, b.snapshot_no) snapshot_no, coalesce(a.rid, b.rid) repository_identifier, coalesce(a.file_path, b.file_path) file_path,
       case when b.rid is null then 'added' when a.rid is null then 'removed' else 'changed' end change_kind
from a full outer join b on a.k = b.k and a.snapshot_no = b.snapshot_no and a.rid = b.rid and a.file_path = b.file_path
where a.v is distinct from b.v
"""


@query(_P1)
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.repository_and_file_changes(table(spark, sf, "repository_snapshots"), table(spark, sf, "file_snapshots"))



# --- the test tables as chunks, questions and vectors ---

_EXT = [".py", ".md", ".js", ".txt", ".go"]
_SPACE = r"\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXT]), (F.col("doc_id") % len(_EXT) + 1).cast("int"))
    path = F.concat(F.coalesce("source", F.lit("src")), F.lit("/doc_"), F.col("doc_id").cast("string"), ext)
    return spread(table(spark, sf, "documents").select("doc_id", "text", "source")).select(F.col("doc_id").alias("chunk_seq"), F.coalesce("text", F.lit("")).alias("content"), path.alias("file_path"))


_INDEXES: dict[tuple[str, str], lexical.Index] = {}


def _index(spark: SparkSession, sf: str) -> lexical.Index:
    """The documents' index, built once; that of other tables is given up."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        for other in list(_INDEXES):
            index = _INDEXES.pop(other)
            if other[0] == key[0]:
                index.clear()
        _INDEXES[key] = lexical.build(_chunks(spark, sf))
    return _INDEXES[key]


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "eval_items").where(F.col("text").isNotNull()).select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def _asked(spark: SparkSession, sf: str, first: bool = False) -> DataFrame:
    """Questions with the vector of the same number; ``first``: the one of the lowest number."""
    asked = _questions(spark, sf).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), "query_id")
    return asked.orderBy("query_id").limit(1) if first else asked


def _embedded(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_seq"), "embedding")
    return _chunks(spark, sf).join(vectors, "chunk_seq", "left")


def _files(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return table(spark, sf, "source_files").select("file_id", *columns).distinct()


def _tokens(x: str) -> str:
    low, word, name = f"lower({x})", r"'[a-zA-Z0-9_-]+|[\x{4e00}-\x{9fff}]+'", r"'[a-zA-Z0-9_-]+\.[a-zA-Z0-9]+'"
    return f"list_distinct(list_filter(list_concat(list_concat(regexp_extract_all({low}, {word}), regexp_extract_all({low}, {name})), list_transform(regexp_extract_all({low}, {name}), lambda y: split_part(y, '.', 1))), lambda y: length(y) > 1))"


_CHUNKS = "chunks as (select doc_id chunk, coalesce(text, '') content, coalesce(source, 'src') || '/doc_' || doc_id || case doc_id % 5 when 0 then '.py' when 1 then '.md' when 2 then '.js' when 3 then '.txt' else '.go' end file_path from documents)"
_ASKED = "asked as (select item_id q, text question from eval_items where text is not null)"
_BM25 = f"""{_CHUNKS},
ct as (select chunk, {_tokens("content || ' ' || file_path")} toks from chunks),
post as (select chunk, unnest(toks) token from ct),
size as (select count(*) n, avg(len(toks)) avgdl from ct),
df as (select token, count(*) df from post group by token),
raw as (select token, df, ln(n - df + 5e-1) - ln(df + 5e-1) raw from df, size),
terms as (select avg(raw) mean_idf, count(*) terms from raw),
idf as (select token, df, case when raw < 0 then 25e-2 * mean_idf else raw end idf from raw, terms),
qt as (select q, unnest({_tokens("question")}) token from asked),
sc as (select q, chunk, sum(idf * 25e-1 / (1 + 15e-1 * (25e-2 + 75e-2 * len(toks) / avgdl))) bm25 from qt join post using (token) join idf using (token) join ct using (chunk), size group by q, chunk)"""


def _boost(chunks: str) -> str:
    return rf"""names as (select q, token from qt where regexp_full_match(token, '[a-zA-Z0-9_-]+\.[a-zA-Z0-9]+')),
pat as (select q, token pattern from names union all select q, split_part(token, '.', 1) from names),
fn as (select chunk, lower(file_path) path, regexp_extract(lower(file_path), '[^/\\]*$') name from {chunks} where file_path <> ''),
bo as (select q, chunk, sum(case when pattern = name or pattern = split_part(name, '.', 1) then 1e1 when contains(name, pattern) then 5e0 else 0e0 end + 2e0) bonus
       from (select distinct pattern from pat) d join fn on contains(path, pattern) join pat using (pattern) group by q, chunk)"""


_TOP = """total as (select q, chunk, round(coalesce(bm25, 0) + coalesce(bonus, 0), 6) score from sc full outer join bo using (q, chunk)),
bt as (select q, chunk, score, row_number() over (partition by q order by score desc, chunk) rank from total where score > 0 qualify rank <= 10)"""


@query(f"select doc_id, unnest({_tokens('coalesce(text, chr(32))')}) token from documents")
def tokenize(spark, sf):
    """Distinct tokens of every document."""
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.explode_outer(text.tokens(F.col("text"))).alias("token")).where("token is not null")  # plain explode would tokenise twice, for a filter it infers


@query(f"with {_ASKED}, {_BM25} select token, df, round(idf, 6) idf from idf")
def bm25_stats(spark, sf):
    """Document frequency and floored weight of every token."""
    return _index(spark, sf).idf.select("token", "df", F.round("idf", 6).alias("idf"))


@query(f"with {_ASKED}, {_BM25} select n chunks, round(avgdl, 6) avgdl, round(mean_idf, 6) mean_idf, terms from size, terms")
def bm25_corpus(spark, sf):
    """Corpus statistics of the index."""
    stats = _index(spark, sf).stats
    return spark.createDataFrame([(stats["chunks"], round(stats["avgdl"], 6), round(stats["mean_idf"], 6), stats["terms"])], "chunks long, avgdl double, mean_idf double, terms long")


@query(f"with {_ASKED}, {_BM25}, {_boost('chunks')}, {_TOP} select q query_id, chunk chunk_seq, score, rank from bt")
def bm25_topk(spark, sf):
    """The ten best chunks of every question, boost included."""
    chunks = _chunks(spark, sf)
    return lexical.top(_index(spark, sf), chunks, _questions(spark, sf)).select(F.col("q").alias("query_id"), F.col("chunk").alias("chunk_seq"), "score", "rank")


@query(
    f"with asked as (select distinct id q, question from query_logs where question is not null), fc as (select distinct file_id chunk, file_path from source_files), qt as (select q, unnest({_tokens('question')}) token from asked), {_boost('fc')} select q query_id, chunk file_id, bonus from bo"
)
def filename_boost(spark, sf):
    """Boost of every file for every logged question that names files."""
    asked = table(spark, sf, "query_logs").select(F.col("id").alias("query_id"), "question").where(F.col("question").isNotNull()).distinct()
    files = _files(spark, sf, "file_path").withColumnRenamed("file_id", "chunk_seq")
    return lexical.boost(files, asked).select(F.col("q").alias("query_id"), F.col("chunk").alias("file_id"), "bonus")


_DIST = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))"


def _vector_sql(base: str, queries: str) -> str:
    d = _DIST.format(a="b.embedding", b="a.embedding")
    return f"select q, chunk, distance, round(1 / (1 + distance), 6) score, rank from (select a.q, b.chunk, round({d}, 6) distance, row_number() over (partition by a.q order by round({d}, 6), b.chunk) rank from ({queries}) a, ({base}) b) where rank <= 10"


_EVERY50 = "select vec_id q, embedding from embeddings where vec_id % 50 = 0"


def _every50(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def _named(df: DataFrame) -> DataFrame:
    return df.select(F.col("q").alias("query_id"), F.col("chunk").alias("vec_id"), "distance", "score", "rank")


@query(f"select q query_id, chunk vec_id, distance, score, rank from ({_vector_sql('select vec_id chunk, embedding from embeddings', _EVERY50)})")
def vector_topk(spark, sf):
    """The ten nearest vectors of every query vector."""
    return _named(vector.top(table(spark, sf, "embeddings"), _every50(spark, sf)))


@query(f"select q query_id, chunk vec_id, distance, score, rank from ({_vector_sql('select vec_id chunk, embedding from embeddings where label = 3', _EVERY50)})")
def vector_topk_filtered(spark, sf):
    """The same among the vectors of one label: the filter comes before the search."""
    return _named(vector.top(table(spark, sf, "embeddings").where(F.col("label") == 3), _every50(spark, sf)))


def _hybrid_sql(first: bool) -> str:
    asked = "asked as (select item_id q, text question from eval_items join embeddings on vec_id = item_id where text is not null" + (" order by item_id limit 1)" if first else ")")
    near = _vector_sql("select vec_id chunk, embedding from embeddings join documents on doc_id = vec_id", "select q, embedding from asked join embeddings on vec_id = q")
    return f"""with {asked}, {_BM25}, {_boost("chunks")}, {_TOP}, vt as ({near}),
hy as (select q, chunk, vt.rank vector_rank, bt.rank bm25_rank, coalesce(1e0 / (60 + vt.rank), 0) + coalesce(1e0 / (60 + bt.rank), 0) rrf from vt full outer join bt using (q, chunk)),
hr as (select *, row_number() over (partition by q order by round(rrf, 12) desc, vector_rank nulls last, bm25_rank nulls last) rank from hy qualify rank <= 10)"""


def _fused(spark: SparkSession, sf: str, first: bool) -> DataFrame:
    return fusion.hybrid(_embedded(spark, sf), _asked(spark, sf, first), _index(spark, sf))


_FUSED = ("query_id", "chunk_seq", "rrf", "vector_rank", "bm25_rank", "rank")


@query(_hybrid_sql(False) + " select q query_id, chunk chunk_seq, round(rrf, 9) rrf, vector_rank, bm25_rank, rank from hr")
def rrf_fusion(spark, sf):
    """Both top lists of every question fused."""
    return _fused(spark, sf, False).select(F.col("q").alias("query_id"), F.col("chunk").alias("chunk_seq"), F.round("rrf", 9).alias("rrf"), "vector_rank", "bm25_rank", "rank")


@query(_hybrid_sql(True) + " select q query_id, chunk chunk_seq, round(rrf, 9) rrf, vector_rank, bm25_rank, rank, file_path from hr join chunks using (chunk)")
def hybrid_search(spark, sf):
    """One question against the collection: the flagship."""
    found = _fused(spark, sf, True)
    return found.join(_chunks(spark, sf), found.chunk == F.col("chunk_seq")).select(F.col("q").alias("query_id"), "chunk_seq", F.round("rrf", 9).alias("rrf"), "vector_rank", "bm25_rank", "rank", "file_path")


@query(_hybrid_sql(False) + " select q query_id, sum(length(content)) chars, round(avg(round(rrf, 9)), 6) mean_score, count(*) n from hr join chunks using (chunk) group by q")
def result_stats(spark, sf):
    """Size and mean score of every question's result."""
    found = _fused(spark, sf, False)
    both = found.join(_chunks(spark, sf), found.chunk == F.col("chunk_seq"))
    return both.groupBy(F.col("q").alias("query_id")).agg(F.sum(F.length("content")).alias("chars"), F.round(F.avg(F.round("rrf", 9)), 6).alias("mean_score"), F.count("*").alias("n"))


_CONTEXT = "string_agg('[文档 ' || rank || '] 文件: ' || file_path || chr(10) || content || chr(10), chr(10) order by rank)"


def _contexts(spark: SparkSession, sf: str) -> DataFrame:
    found = _fused(spark, sf, False)
    both = found.join(_chunks(spark, sf), found.chunk == F.col("chunk_seq"))
    return both.groupBy("q").agg(fusion.context(F.col("rank"), F.col("file_path"), F.col("content")).alias("context"))


@query(_hybrid_sql(False) + f" select q query_id, {_CONTEXT} context from hr join chunks using (chunk) group by q")
def build_context(spark, sf):
    """The passages of every question's result as one text."""
    return _contexts(spark, sf).select(F.col("q").alias("query_id"), "context")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(_hybrid_sql(False) + f" select q query_id, {_quoted(fusion.PROMPT_HEAD)} || {_CONTEXT} || {_quoted(fusion.PROMPT_QUESTION)} || any_value(question) || {_quoted(fusion.PROMPT_TAIL)} prompt from hr join chunks using (chunk) join asked using (q) group by q")
def build_prompt(spark, sf):
    """The prompt of every question."""
    both = _contexts(spark, sf).join(_questions(spark, sf), F.col("q") == F.col("query_id"))
    return both.select("query_id", fusion.prompt(F.col("question"), F.col("context")).alias("prompt"))


# --- addresses ---

_URL = "urls as (select distinct repository_url url from analysis_sessions where repository_url is not null)"
_PARTS = r"list_filter(string_split(regexp_replace(regexp_replace(case when regexp_matches({u}, '^https?://') then {u} else 'https://' || {u} end, '^https?://[^/?#]*', ''), '[?#].*$', ''), '/'), lambda x: x <> '')"


def _urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "analysis_sessions").select(F.col("repository_url").alias("url")).where("url is not null").distinct()


_IDENT = rf"(select url, p[1] o, regexp_replace(p[2], '\.git$', '') n from (select url, {_PARTS.format(u='lower(trim(url))')} p from urls))"


@query(f"with {_URL} select url, 'github_' || o || '_' || n || '_' || substr(sha256(o || '/' || n), 1, 8) identifier from {_IDENT}")
def repo_identifier(spark, sf):
    return _urls(spark, sf).select("url", urls.repository_identifier(F.col("url")).alias("identifier"))


@query(rf"with {_URL} select url, coalesce(regexp_matches(url, '^https?://') and regexp_extract(url, '^https?://([^/?#]*)', 1) in ('github.com', 'www.github.com') and len({_PARTS.format(u='url')}) >= 2, false) valid from urls")
def url_valid(spark, sf):
    return _urls(spark, sf).select("url", urls.valid(F.col("url")).alias("valid"))


@query(rf"with {_URL} select url, p[1] owner, regexp_replace(p[2], '\.git$', '') name from (select url, {_PARTS.format(u='trim(url)')} p from urls)")
def repo_owner_name(spark, sf):
    u = F.col("url")
    return _urls(spark, sf).select("url", urls.owner(u).alias("owner"), urls.name(u).alias("name"))


@query(rf"with {_URL} select url, regexp_matches(url, '^https?://github\.com/.+/.+') or regexp_matches(url, '^github\.com/.+/.+') or regexp_matches(url, '^.+/.+\.git$') looks_like from urls")
def url_like(spark, sf):
    return _urls(spark, sf).select("url", urls.looks_like(F.col("url")).alias("looks_like"))


# --- paths ---

_PATHS = r"fp as (select distinct file_id, file_size, regexp_replace(replace(file_path, chr(92), '/'), '^(\./|/)+', '') p from source_files where file_path is not null), pp as (select *, string_split(p, '/')[-1] base, regexp_extract(lower(string_split(p, '/')[-1]), '^\.*[^.].*?(\.[^.]*)$', 1) ext from fp)"


def _paths(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    rows = _files(spark, sf, "file_path", *more).where(F.col("file_path").isNotNull())
    return rows.withColumn("p", paths.unify(F.col("file_path")))


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_TYPE = f"case when ext in {_in(paths.CODE)} then 'code' when ext in {_in(paths.DOCUMENT)} then 'document' when ext in {_in(paths.CONFIG)} then 'config' " + " ".join(f"when starts_with(lower(base), '{k}') then '{v}'" for k, v in paths.SPECIAL.items()) + " else 'unknown' end"
_LANG = "case ext " + " ".join(f"when '{k}' then '{v}'" for k, v in (paths.CODE | paths.DOCUMENT).items() if v) + " end"


@query(f"with {_PATHS} select file_id, {_TYPE} kind, {_LANG} language from pp")
def file_typing(spark, sf):
    p = F.col("p")
    return _paths(spark, sf).select("file_id", paths.file_type(p).alias("kind"), paths.language(p).alias("language"))


@query(f"with {_PATHS} select file_id, case when ext in {_in(paths.BINARY)} then false when ext <> '' then ext in {_in(paths.ALLOWED)} else lower(base) in {_in(paths.SPECIAL)} end admitted from pp")
def file_admission(spark, sf):
    return _paths(spark, sf).select("file_id", paths.admitted(F.col("p")).alias("admitted"))


@query(f"with {_PATHS} select file_id, len(list_filter(string_split(p, '/')[:-2], lambda x: x in {_in(paths.EXCLUDED)} or starts_with(x, '.'))) > 0 pruned from pp")
def dir_prune(spark, sf):
    return _paths(spark, sf).select("file_id", paths.pruned(F.col("p")).alias("pruned"))


_IGNORE = ["*.min.js", "build/*", "# comment", "", "*.env", "docs/*", "!keep.md", "test?/*"]


@query(f"with {_PATHS} select file_id, " + " or ".join(f"p glob '{x}' or base glob '{x}'" for x in _IGNORE if x and x[0] not in "#!") + " ignored from pp")
def gitignore_filter(spark, sf):
    """Shell patterns of an ignore file; a leading exclamation mark has no meaning here."""
    return _paths(spark, sf).select("file_id", paths.ignored(F.col("p"), _IGNORE).alias("ignored"))


@query(f"with {_PATHS} select file_id, case when {_TYPE} = 'code' and file_size <= {paths.MAX_PARSE_BYTES} and ext in {_in(paths.PARSED)} then 'syntax' else 'text' end route from pp")
def ast_route(spark, sf):
    return _paths(spark, sf, "file_size").select("file_id", paths.syntax_route(F.col("p"), F.col("file_size")).alias("route"))


# --- text ---


@query(rf"select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\r\n|\r', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g') cleaned from documents where text is not null")
def clean_text(spark, sf):
    """Cleaning but for the compatibility forms, which SQL lacks."""
    return table(spark, sf, "documents").where("text is not null").select("doc_id", text.clean(F.col("text"), normalise=False).alias("cleaned"))


@query()
def clean_text_nfkc(spark, sf):
    """The whole cleaning."""
    return spread(table(spark, sf, "documents").where("text is not null").select("doc_id", "text")).select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@query("select doc_id, len(string_split(text, chr(10))) lines from documents where text is not null")
def line_count(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", text.line_count(F.col("text")).alias("lines"))


@query(f"select doc_id, length(regexp_replace(text, '[{_SPACE}]', '', 'g')) nonws from documents where text is not null")
def nonws_len(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", text.nonws_len(F.col("text")).alias("nonws"))


@query("with t as (select distinct file_id, content from source_files where content is not null) select file_id, " + " or ".join(f"starts_with(regexp_replace(content, '^[{_SPACE}]+', ''), '{b}')" for b in text.BOUNDARIES) + " boundary from t")
def major_boundary(spark, sf):
    return _files(spark, sf, "content").where("content is not null").select("file_id", text.major_boundary(F.col("content")).alias("boundary"))


@query("with t as (select distinct file_id, content from source_files where content is not null) select file_id, length(c) chars, md5(c) digest from (select file_id, regexp_replace(regexp_replace(content, '\\r\\n|\\r', chr(10), 'g'), '^\\x{feff}', '') c from t)")
def decode_text(spark, sf):
    """The files' bytes read back as text."""
    decoded = text.decode(F.encode("content", "UTF-8"))
    return _files(spark, sf, "content").where("content is not null").select("file_id", F.length(decoded).alias("chars"), F.md5(decoded).alias("digest"))


_SPECIAL = f"""with f as (select distinct file_id, lower(string_split(replace(file_path, chr(92), '/'), '/')[-1]) base, content from source_files where content is not null),
k as (select *, case when base = 'package.json' and json_valid(content) and json_type(case when json_valid(content) then content end) = 'OBJECT' then 'package_json' when base in ('requirements.txt', 'requirements-dev.txt') then 'requirements' when base = 'pyproject.toml' then 'pyproject_toml' when starts_with(base, 'dockerfile') then 'dockerfile' else 'unknown' end kind,
  list_filter(list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')), lambda x: x <> '' and not starts_with(x, '#')) l from f)
select file_id, kind, case when kind = 'requirements' then array_to_string(l, chr(10)) when kind = 'dockerfile' then array_to_string(list_filter(list_transform(l, lambda x: upper(x)), lambda x: regexp_matches(x, '^({special.INSTRUCTIONS})')), chr(10)) end lines from k"""


@query(_SPECIAL)
def parse_special(spark, sf):
    """Kind and lines of files that name dependencies or build steps."""
    path, content = F.translate("file_path", "\\", "/"), F.col("content")
    rows = _files(spark, sf, "file_path", "content").where("content is not null")
    return rows.select("file_id", special.special_kind(path, content).alias("kind"), F.array_join(special.special_lines(path, content), "\n").alias("lines"))


# --- chunks ---


@query()
def recursive_chunks(spark, sf):
    """Every document in pieces by its language's separators."""
    docs = table(spark, sf, "documents").select(F.col("doc_id"), "text", F.when(F.col("doc_kind") == "code", "python").when(F.col("doc_kind").isin("guide", "readme", "design"), "markdown").alias("language"))
    return chunking.chunk_files(spread(docs), "doc_id", "text", header=False).select("doc_id", F.col("local_idx").alias("piece"), "content", "start_line")


@query()
def syntax_chunks(spark, sf):
    """Every file in pieces, by syntax where its type and size allow."""
    files = _files(spark, sf, "file_path", "content", "file_size")
    p = paths.unify(F.col("file_path"))
    ready = files.withColumn("language", paths.language(p)).withColumn("route", paths.syntax_route(p, F.col("file_size")))
    return chunking.chunk_files(spread(ready), "file_id", route="route", header=False)


_SEQ = "q as (select repository_identifier, file_path, file_id, row_number() over (partition by repository_identifier order by file_path, file_id) - 1 chunk_seq from (select distinct repository_identifier, file_path, file_id from source_files))"


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "source_files").select("repository_identifier", "file_path", "file_id").distinct()
    return catalog.assign_chunk_ids(rows, order=("file_path", "file_id"))


@query(f"with {_SEQ} select file_id, chunk_seq, 'chunk_repo_' || repository_identifier || '_' || chunk_seq chunk_id from q")
def assign_chunk_ids(spark, sf):
    """Contiguous numbers within each repository, in order of path."""
    return _numbered(spark, sf).select("file_id", "chunk_seq", "chunk_id")


@query(f"with {_SEQ} select repository_identifier, chunk_seq // 32 batch, count(*) n from q group by all")
def embed_batches(spark, sf):
    """How chunks fall into embedding calls of 32."""
    rows = _numbered(spark, sf).withColumn("batch", F.floor(F.col("chunk_seq") / 32))
    return rows.groupBy("repository_identifier", "batch").agg(F.count("*").alias("n"))


# --- bookkeeping ---

_FOLD = ["status", "error_message", "repository_url", "repository_name", "repository_owner", "repository_identifier", "total_files", "processed_files", "total_chunks", "indexed_chunks", "started_at", "completed_at"]
_TIMES = ["started_at", "completed_at"]


@query("select session_id, epoch_us(max(updated_at)) updated_us, " + ", ".join(f"{'epoch_us(' if c in _TIMES else '('}arg_max({c}, coalesce(updated_at, timestamp '1900-01-01')) filter (where {c} is not null)) {c}" for c in _FOLD) + " from analysis_sessions where session_id is not null group by session_id")
def session_fold(spark, sf):
    """The latest known value of every field of every session."""
    folded = catalog.fold_sessions(table(spark, sf, "analysis_sessions").select("session_id", "updated_at", *_FOLD))
    return folded.select("session_id", F.unix_micros("updated_at").alias("updated_us"), *[F.unix_micros(c).alias(c) if c in _TIMES else F.col(c) for c in _FOLD])


@query("with s as (select distinct session_id, total_chunks, indexed_chunks, started_at, completed_at from analysis_sessions) select session_id, round(case when coalesce(total_chunks, 0) = 0 then 0 else coalesce(indexed_chunks, 0) / total_chunks * 1e2 end, 6) progress, round((epoch_us(completed_at) - epoch_us(started_at)) / 1e6, 6) duration from s")
def session_progress(spark, sf):
    rows = table(spark, sf, "analysis_sessions").select("session_id", "total_chunks", "indexed_chunks", "started_at", "completed_at").distinct()
    return rows.select("session_id", F.round(catalog.progress(F.col("total_chunks"), F.col("indexed_chunks")), 6).alias("progress"), F.round(catalog.duration(F.col("started_at"), F.col("completed_at")), 6).alias("duration"))


@query("with f as (select distinct file_id, session_id, is_processed, chunk_count from source_files) select session_id, count(*) total_files, count(*) filter (where is_processed = 'success') processed_files, count(*) filter (where is_processed = 'failed') failed_files, count(*) filter (where is_processed = 'skipped') skipped_files, coalesce(sum(chunk_count) filter (where is_processed = 'success'), 0)::bigint total_chunks from f group by session_id")
def session_stats(spark, sf):
    """Files and chunks of every session."""
    return catalog.session_stats(_files(spark, sf, "session_id", "is_processed", "chunk_count"))


@query(f"with f as (select distinct file_id, content, error_message from source_files) select case when error_message is not null then 'failed' when content is null or regexp_replace(content, '[{_SPACE}]', '', 'g') = '' then 'skipped' else 'success' end outcome, count(*) files from f group by 1")
def file_outcomes(spark, sf):
    return catalog.file_outcomes(_files(spark, sf, "content", "error_message")).groupBy("outcome").agg(F.count("*").alias("files"))


_OK = "ok as (select * from analysis_sessions where status = 'success')"


@query(
    rf"""with {_OK}, req as (select session_id request from analysis_sessions where session_id is not null union select repository_url from analysis_sessions where repository_url is not null),
byid as (select request, max(session_id) session_id, max(repository_identifier) repository_identifier from req join ok on session_id = request group by request),
lat as (select repository_identifier, session_id from (select repository_identifier, session_id, row_number() over (partition by repository_identifier order by completed_at desc nulls last, session_id desc nulls last) n from ok where repository_identifier is not null) where n = 1),
lk as (select request url from req where request not in (select request from byid) and (regexp_matches(request, '^https?://github\.com/.+/.+') or regexp_matches(request, '^github\.com/.+/.+') or regexp_matches(request, '^.+/.+\.git$'))),
urls as (select url from lk), idn as (select url request, 'github_' || o || '_' || n || '_' || substr(sha256(o || '/' || n), 1, 8) repository_identifier from {_IDENT}),
byurl as (select request, lat.session_id, idn.repository_identifier from idn join lat using (repository_identifier))
select req.request, a.session_id, a.repository_identifier from req left join (select * from byid union all select * from byurl) a using (request)"""
)
def session_resolve(spark, sf):
    """Which session every id or address means."""
    sessions = table(spark, sf, "analysis_sessions")
    requests = sessions.select(F.col("session_id").alias("request")).union(sessions.select("repository_url"))
    return catalog.resolve_sessions(requests, sessions)


@query(
    """select generation_mode, count(*) queries, count(answer) answered, sum(retrieved_chunks_count)::bigint chunks, min(total_time) fastest, max(total_time) slowest, round(avg(retrieval_time), 6) retrieval, round(avg(generation_time), 6) generation
from (select distinct id, generation_mode, answer, retrieved_chunks_count, total_time, retrieval_time, generation_time from query_logs) group by generation_mode"""
)
def query_log(spark, sf):
    """Use and timings of the logged queries by mode; repeated rows count once."""
    log = table(spark, sf, "query_logs").select("id", "generation_mode", "answer", "retrieved_chunks_count", "total_time", "retrieval_time", "generation_time").distinct()
    return log.groupBy("generation_mode").agg(
        F.count("*").alias("queries"), F.count("answer").alias("answered"), F.sum("retrieved_chunks_count").alias("chunks"), F.min("total_time").alias("fastest"), F.max("total_time").alias("slowest"),
        F.round(F.avg("retrieval_time"), 6).alias("retrieval"), F.round(F.avg("generation_time"), 6).alias("generation"),
    )


@query(
    """with r as (select snapshot_no, lower(trim(repository_identifier)) repository_identifier from repository_snapshots where repository_identifier is not null)
select distinct repository_identifier from r where repository_identifier not in (select repository_identifier from r where snapshot_no = (select min(snapshot_no) from r))"""
)
def ingest_dedupe(spark, sf):
    """Repositories ever delivered of which the first delivery held no collection."""
    every = table(spark, sf, "repository_snapshots").select("snapshot_no", F.lower(F.trim("repository_identifier")).alias("repository_identifier"))
    first = every.where(F.col("repository_identifier").isNotNull()).agg(F.min("snapshot_no").alias("snapshot_no"))
    return catalog.not_yet_ingested(every.select("repository_identifier"), every.join(F.broadcast(first), "snapshot_no"))


@query("select repository_identifier, count(*) chunks from documents group by 1")
def collection_stats(spark, sf):
    return catalog.collection_stats(table(spark, sf, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
