"""Text, image, chunking, vector and search queries with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.functions import text as fn, vector as vx
from graphloom.operators import chunking, images, lines, search, vectors
from graphloom.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_WS = r"[ \t\n\r\f]"


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_CUT = rf"string_split(regexp_replace(text, '([.?!]){_WS}+', '\1' || chr(1), 'g'), chr(1))"
_SENT = f"s as (select doc_id, unnest({_CUT}) as sentence, unnest(range(len({_CUT}))) as idx from documents where text is not null)"


@query(f"with {_SENT} select doc_id, idx::int as idx, sentence from s")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return lines.sentence_table(table(spark, d, "documents"), "doc_id", "text")


@query(f"with {_SENT} select doc_id, idx::int as idx, sentence, string_agg(sentence, ' ' order by idx) over (partition by doc_id order by idx rows between 1 preceding and 1 following) as combined from s")
def sentence_window(spark: SparkSession, d: str) -> DataFrame:
    return lines.sentence_windows(lines.sentence_table(table(spark, d, "documents"), "doc_id", "text"), "doc_id")


@query(f"select doc_id, length(text)::int as char_count, len(list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> ''))::int as word_count, (length(text) // 4)::int as tokens from documents")
def char_word_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.length(t).alias("char_count"), fn.word_count(t).alias("word_count"), fn.token_estimate(t).alias("tokens"))


@query("select doc_id, case when length(text) > 500 then text[1:500] || '...' else text end as excerpt, case when length(text) > 4000 then text[1:4000] else text end as prompt_text from documents")
def excerpt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", fn.excerpt(F.col("text"), 500, "...").alias("excerpt"), fn.excerpt(F.col("text"), 4000).alias("prompt_text"))


_LINES = "l as (select chunk_key, unnest(string_split(content, chr(10))) as line, unnest(range(1, len(string_split(content, chr(10))) + 1)) as line_no from chunks where content is not null)"
_STRIP = f"regexp_replace(line, '^{_WS}+|{_WS}+$', '', 'g')"


@query(f"with {_LINES} select chunk_key, line_no::int as line_no, line from l")
def markdown_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.lines(table(spark, d, "chunks"), "chunk_key", "content")


_HEADER = rf"""(regexp_matches({_STRIP}, '^##+[ \t]*\*?\*?[^*]') or regexp_matches({_STRIP}, '^\*\*[0-9]+(\.[0-9]+)?\*\*[ \t]+\*\*[^*]')
 or (regexp_matches({_STRIP}, '^\*\*[A-Z][^*]*\*\*$') and length({_STRIP}) < 100 and regexp_matches({_STRIP}, 'Abstract|Introduction|Background|Conclusion|References|Acknowledgements|Acknowledgments')))"""
_HEADTEXT = rf"regexp_replace(regexp_replace(replace(regexp_replace({_STRIP}, '^##+{_WS}*', ''), '**', ''), '{_WS}+', ' ', 'g'), '^{_WS}+|{_WS}+$', '', 'g')"


@query(
    f"with {_LINES} select chunk_key, line_no::int as line_no, last_value(case when {_HEADER} then {_HEADTEXT} end ignore nulls) over (partition by chunk_key order by line_no rows between unbounded preceding and current row) as section from l"
)
def section_header_ffill(spark: SparkSession, d: str) -> DataFrame:
    return lines.section_of(lines.lines(table(spark, d, "chunks"), "chunk_key", "content"), "chunk_key").select("chunk_key", "line_no", "section")


@query(
    f"with {_LINES} select chunk_key, line_no::int as line_no, last_value(case when regexp_matches({_STRIP}, '^[0-9]{{1,9}}$') then {_STRIP}::int end ignore nulls) over (partition by chunk_key order by line_no rows between 10 preceding and 1 preceding) as page from l"
)
def page_lookback(spark: SparkSession, d: str) -> DataFrame:
    return lines.page_near(lines.lines(table(spark, d, "chunks"), "chunk_key", "content"), "chunk_key").select("chunk_key", "line_no", "page")


_DROP = rf"""(contains(lower(line), 'this page intentionally left blank') or regexp_matches(line, '^{_WS}*[0-9]+{_WS}*$') or regexp_matches(lower(line), '^{_WS}*[ivxlcdm]+{_WS}*$')
 or regexp_matches(line, 'New York|Chicago|San Francisco|Lisbon|London|Madrid|Mexico City') or regexp_matches(line, '^[^\p{{L}}\p{{N}}]{{10,}}$')
 or (length({_STRIP}) > 0 and length({_STRIP}) < 5 and not regexp_matches({_STRIP}, '^([A-Za-z0-9]|{_WS})+$')))"""
_KEPT = f"""k as (select * from (select *, coalesce(min(case when lower({_STRIP}) in ('contents', 'foreword') then line_no end) over (partition by chunk_key), 1) as start from l) where line_no >= start and not {_DROP})"""


@query(f"with {_LINES}, {_KEPT} select chunk_key, line_no::int as line_no, line from k")
def clean_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.clean(lines.lines(table(spark, d, "chunks"), "chunk_key", "content"), "chunk_key")


@query(
    f"""with {_LINES}, {_KEPT}, j as (select chunk_key, regexp_replace(string_agg(line, chr(10) order by line_no), '\\n{{3,}}', chr(10) || chr(10), 'g') as body from k group by chunk_key)
select chunk_key, regexp_replace(array_to_string(list_transform(string_split(body, chr(10)), lambda x: regexp_replace(x, '{_WS}+$', '')), chr(10)), '^{_WS}+|{_WS}+$', '', 'g') as text from j"""
)
def clean_markdown(spark: SparkSession, d: str) -> DataFrame:
    return lines.clean_text(table(spark, d, "chunks"), "chunk_key", "content")


@query(
    f"with {_LINES}, m as (select *, case when starts_with({_STRIP}, '```') then 1 else 0 end as m from l) select chunk_key, line_no::int as line_no, (sum(m) over (partition by chunk_key order by line_no) % 2 = 1 or m = 1) as fenced from m"
)
def fence_state(spark: SparkSession, d: str) -> DataFrame:
    return lines.in_fence(lines.lines(table(spark, d, "chunks"), "chunk_key", "content"), "chunk_key").select("chunk_key", "line_no", "fenced")


_BLOCKS = r"""b as (select chunk_key, unnest(regexp_extract_all(content, '(?is)```json\s*(.*?)\s*```', 1)) as body from chunks where content is not null),
j as (select chunk_key, try_cast(regexp_replace('{' || regexp_replace(body, ',\s*$', '') || '}', ',\s*([}\]])', '\1', 'g') as json) as j from b),
i as (select chunk_key, unnest(json_keys(j)) as image_id, j from j where j is not null),
g as (select chunk_key, image_id, json_extract(j, '$."' || image_id || '"') as meta from i where starts_with(image_id, 'img_'))"""


@query(f"with {_BLOCKS} select chunk_key, image_id, meta->>'path' as path, (meta->>'page')::int as page, meta->>'section' as section from g")
def fenced_json_images(spark: SparkSession, d: str) -> DataFrame:
    found = images.block_images(table(spark, d, "chunks"), "chunk_key", "content")
    return found.select("chunk_key", "image_id", "meta.path", "meta.page", "meta.section")


@query(
    f"""with {_BLOCKS}, s as (select g.*, regexp_replace(c.metadata.source, '\\.md$', '') as doc from g join chunks c using (chunk_key))
select distinct rel, 'Image' as src_type, image_id as src, dst_type, dst from (
 select 'PART_OF' as rel, image_id, 'Document' as dst_type, doc as dst from s
 union all select 'LOCATED_IN', image_id, 'Section', doc || '::section::' || coalesce(nullif(meta->>'section', ''), 'Unknown') from s
 union all select 'DEPICTS', image_id, 'Concept', 'Figure on page ' || (meta->>'page') from s where meta->>'page' is not null)"""
)
def image_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """The image graph of the chunks' blocks, captions and concepts given by a deterministic caption provider."""
    chunks = table(spark, d, "chunks")
    found = images.block_images(chunks, "chunk_key", "content")
    captions = found.select("image_id", F.concat(F.lit("Figure "), "image_id").alias("caption"), F.when(F.col("meta.page").isNotNull(), F.array(F.concat(F.lit("Figure on page "), F.col("meta.page").cast("string")))).alias("depicted_concepts"))
    captions = captions.groupBy("image_id").agg(F.max("caption").alias("caption"), F.max("depicted_concepts").alias("depicted_concepts"))
    told = images.merge_captions(found, captions).join(chunks.select("chunk_key", "metadata"), "chunk_key")
    return images.image_graph(told, F.regexp_replace("metadata.source", r"\.md$", ""))


_MD = """md as (select chunk_key, string_agg('![](' || (meta->>'path') || ')', chr(10) order by image_id) as text from g group by chunk_key)"""


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    """Markdown with image references, made of the blocks' paths."""
    found = images.block_images(table(spark, d, "chunks"), "chunk_key", "content")
    rows = F.array_sort(F.collect_list(F.struct("image_id", F.concat(F.lit("![]("), F.col("meta.path"), F.lit(")")).alias("ref"))))
    return found.groupBy("chunk_key").agg(F.array_join(F.transform(rows, lambda x: x["ref"]), "\n").alias("text"))


@query(
    rf"""with {_BLOCKS}, {_MD} select chunk_key, unnest(range(1, len(string_split(text, chr(10))) + 1))::int as line_no,
unnest(list_transform(string_split(text, chr(10)), lambda x: regexp_extract(x, '!\[[^\]]*\]\(([^)]+)\)', 1))) as image_path,
unnest(list_transform(string_split(text, chr(10)), lambda x: nullif(regexp_extract(x, '(?i)-(\d+)-\d+\.(png|jpg|jpeg|gif|svg)', 1), '')::int)) as page_number from md"""
)
def image_refs(spark: SparkSession, d: str) -> DataFrame:
    return images.image_refs(_markdown(spark, d), "chunk_key", "text").select("chunk_key", "line_no", "image_path", "page_number")


@query(rf"""with {_BLOCKS} select distinct meta->>'path' as path, regexp_extract(meta->>'path', '-(\d+)-\d+\.(png|jpg|jpeg|gif|svg)', 1)::int as page from g""")
def page_from_filename(spark: SparkSession, d: str) -> DataFrame:
    found = images.block_images(table(spark, d, "chunks"), "chunk_key", "content")
    return found.select(F.col("meta.path").alias("path"), fn.page_from_filename(F.col("meta.path")).alias("page")).distinct()


@query(
    rf"""with {_BLOCKS}, p as (select distinct regexp_extract(meta->>'path', '[^/]+$') as name, meta->>'path' as path from g)
select path, 'img_' || regexp_extract(name, '^(.+?)\.pdf-(\d+)-(\d+)\.', 1) || '_' || regexp_extract(name, '^(.+?)\.pdf-(\d+)-(\d+)\.', 2) || '_' || regexp_extract(name, '^(.+?)\.pdf-(\d+)-(\d+)\.', 3) as image_id from p"""
)
def image_ids(spark: SparkSession, d: str) -> DataFrame:
    found = images.block_images(table(spark, d, "chunks"), "chunk_key", "content").select(F.col("meta.path").alias("path")).distinct()
    return found.select("path", fn.image_id(F.col("path"), F.lit("unknown")).alias("image_id"))


@query()
def images_with_ids(spark: SparkSession, d: str) -> DataFrame:
    """Markdown whose image references became metadata blocks with stable ids."""
    return images.assign_ids(_markdown(spark, d), "chunk_key", "text", F.lit("unknown"))


@query(
    """select graph_doc_id, case when ok then split_part(source_id, '::', 1) end as file, case when ok then substr(source_id, instr(source_id, '::') + 2) end as chunk_id, string_split(source_id, '::')[-1] as last_part
from (select graph_doc_id, source_id, (split_part(source_id, '::', 1) like '%.jsonl' and source_id like '%::_%') as ok from graph_sources)"""
)
def parse_source_id(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.operators.graph_match import split_pointer

    file, chunk = split_pointer(F.col("source_id"))
    return table(spark, d, "graph_sources").select("graph_doc_id", file.alias("file"), chunk.alias("chunk_id"), fn.last_segment(F.col("source_id")).alias("last_part"))


@query("select chunk_key, id, nullif(regexp_extract(id, '(_[0-9]+)$', 1), '') as suffix from chunks")
def numeric_suffix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_key", "id", fn.numeric_suffix(F.col("id")).alias("suffix"))


@query("select metadata.source as source, count(*) as n from chunks group by 1")
def chunks_per_file(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").groupBy(F.col("metadata.source").alias("source")).agg(F.count(F.lit(1)).alias("n"))


_FILE = "metadata.source || '#' || token_size_config"


@query(
    f"""with recursive c as (select {_FILE} as file, chunk_index, chunk_key as chunk_ref, (length(content) // 4)::int as tokens, row_number() over (partition by {_FILE} order by chunk_index, chunk_key) as rn from chunks where length(content) > 0),
r as (select file, chunk_index, chunk_ref, tokens, rn, 0 as batch, tokens as total from c where rn = 1
 union all select c.file, c.chunk_index, c.chunk_ref, c.tokens, c.rn, case when r.total > 0 and r.total + c.tokens > 600 then r.batch + 1 else r.batch end, case when r.total > 0 and r.total + c.tokens > 600 then c.tokens else r.total + c.tokens end from r join c on c.file = r.file and c.rn = r.rn + 1)
select file, chunk_index, chunk_ref, tokens, batch from r"""
)
def adaptive_batches(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").withColumn("file", F.concat(F.col("metadata.source"), F.lit("#"), F.col("token_size_config").cast("string")))
    return chunking.adaptive_batches(chunks, "file", "chunk_index", "content", 600, "chunk_key")


@query(
    ORACLES["adaptive_batches"].replace("select file, chunk_index, chunk_ref, tokens, batch from r", "")
    + """, g as (select file, batch, list(chunk_ref order by chunk_index, chunk_ref) as ids from r group by 1, 2)
select file, batch, case when len(ids) = 1 then file || '.jsonl::' || ids[1] else file || '::batch::' || ids[1] end as source_id, case when len(ids) = 1 then 'chunk' else 'chunk_batch' end as source_type, array_to_string(ids, ',') as ids from g"""
)
def batch_provenance(spark: SparkSession, d: str) -> DataFrame:
    """The provenance pointer of every extraction batch."""
    return chunking.batch_sources(adaptive_batches(spark, d), "file", "chunk_ref").withColumn("ids", F.array_join("ids", ","))


@query()
def token_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as recursive chunks of two granularities."""
    docs = table(spark, d, "documents").withColumn("stem", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))
    return chunking.token_chunks(docs, "doc_id", "text", "stem")


_Q = "q as (select vec_id as query_id, embedding from embeddings where vec_id % 50 = 0)"
_HITS = f"""{_Q}, h as (select query_id, e.vec_id, list_cosine_similarity(q.embedding::double[], e.embedding::double[]) as s from q, embeddings e),
r as (select query_id, vec_id, round(s, 6) as score, row_number() over (partition by query_id order by round(s, 9) desc, vec_id) as rank from h)"""


def _hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = table(spark, d, "embeddings")
    return vectors.knn(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select("vec_id", "embedding"), k)


@query(f"with {_HITS} select query_id, vec_id, score, rank::int as rank from r where rank <= 5")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, 5)


@query(f"with {_HITS} select vec_id, query_id, score, rank::int as rank from (select *, row_number() over (partition by vec_id order by query_id, rank) as n from r where rank <= 3) where n = 1")
def multi_query_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return vectors.first_hits(_hits(spark, d, 3), ["vec_id"])


@query("select vec_id, list_transform(embedding::double[], lambda x: round(x / sqrt(list_inner_product(embedding::double[], embedding::double[])), 6)) as unit from embeddings")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.transform(vx.unit(F.col("embedding")), lambda x: F.round(x, 6)).alias("unit"))


_DIST = "x as (select *, lead(embedding) over (partition by label order by vec_id) as nxt from embeddings), a as (select label, vec_id, case when nxt is not null then 1 - list_cosine_similarity(embedding::double[], nxt::double[]) end as distance from x)"


@query(f"with {_DIST} select label, vec_id, round(distance, 6) as distance from a")
def adjacent_cosine_distance(spark: SparkSession, d: str) -> DataFrame:
    return vectors.adjacent_distance(table(spark, d, "embeddings"), "label", "vec_id").select("label", "vec_id", F.round("distance", 6).alias("distance"))


_BREAK = f"{_DIST}, p as (select label, quantile_cont(distance, 0.95) as t from a group by label), k as (select a.label, vec_id, distance, t, coalesce(distance > t, false) as b from a join p using (label)), g as (select *, coalesce(sum(b::int) over (partition by label order by vec_id rows between unbounded preceding and 1 preceding), 0) as grp from k)"


def _islands(spark: SparkSession, d: str) -> DataFrame:
    dist = vectors.adjacent_distance(table(spark, d, "embeddings"), "label", "vec_id").select("label", "vec_id", "distance")
    return vectors.breakpoints(dist, "label", "vec_id")


@query(f"with {_BREAK} select label, vec_id, round(t, 6) as threshold, b as is_break, grp::int as grp from g")
def semantic_breakpoints(spark: SparkSession, d: str) -> DataFrame:
    return _islands(spark, d).select("label", "vec_id", F.round("threshold", 6).alias("threshold"), "is_break", "grp")


@query(f"with {_BREAK}, c as (select label, grp, string_agg('s' || vec_id, ' ' order by vec_id) as text from g group by 1, 2) select label, grp::int as chunk_index, text, length(text)::int as char_count, len(string_split(text, ' '))::int as word_count from c")
def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = _islands(spark, d).withColumn("sentence", F.concat(F.lit("s"), F.col("vec_id").cast("string")))
    return chunking.semantic_chunks(rows, "label", "vec_id", "sentence")


@query(
    """with w as (select chunk_key, regexp_extract_all(lower(coalesce(content, '')), '[\\p{L}\\p{N}]+') as w from chunks),
c as (select chunk_key, len(w) as n, len(list_filter(w, lambda x: x = 'attention')) as a, len(list_filter(w, lambda x: x = 'sparse')) as b from w),
s as (select count(*) as docs, avg(n) as mean, count(*) filter (where a > 0) as da, count(*) filter (where b > 0) as db from c)
select chunk_key, round(ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6) as score
from c, s where a > 0 or b > 0 order by score desc, chunk_key limit 5"""
)
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(table(spark, d, "chunks"), "chunk_key", "content", ["sparse", "attention"])


@query(
    f"""with {_HITS}, f as (select *, row_number() over (partition by vec_id order by query_id, rank) as n from r where rank <= 3)
select query_id, string_agg('[Document ' || rank || '] vector ' || vec_id, chr(10) || '---' || chr(10) || chr(10) order by rank) as context from f where n = 1 group by query_id"""
)
def rag_context(spark: SparkSession, d: str) -> DataFrame:
    first = vectors.first_hits(_hits(spark, d, 3), ["vec_id"])
    part = F.concat(F.lit("[Document "), F.col("rank").cast("string"), F.lit("] vector "), F.col("vec_id").cast("string"))
    rows = F.array_sort(F.collect_list(F.struct("rank", part.alias("text"))))
    return first.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n---\n\n").alias("context"))


@query()
def lsh_topk(spark: SparkSession, d: str) -> DataFrame:
    """Approximate neighbours; recall against :func:`cosine_topk` is measured in the tests."""
    e = table(spark, d, "embeddings")
    return vectors.lsh_neighbours(e.select("vec_id", "embedding"), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5)
