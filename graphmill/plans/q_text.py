"""Queries of scans, projections, predicates and scalar functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.functions import classify as C
from graphmill.functions import paths as P
from graphmill.functions import text as T
from graphmill.functions import vectors as V
from graphmill.plans import fixtures as X
from graphmill.session import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql.replace(r"\S+", f"[^{T.WHITE_SPACE}]+")
        return f

    return add


def _docs(s, d, *cols) -> DataFrame:
    return table(s, d, "documents").filter("text is not null").select("doc_id", "text", *cols)


#: Fixed pieces of SQL: Unicode letters and digits, and the words of an identifier.
_CT = r"list_filter(regexp_split_to_array(regexp_replace(lower(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^\p{{L}}\p{{N}}]', ' ', 'g'), ' +'), lambda t: strlen(t) > 1)"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _useful(toks: str) -> str:
    drop = _list(T.STOPWORDS + list(T.relation_map()))
    return f"list_sort(list_distinct(list_filter({toks}, lambda t: not list_contains({drop}, t))))[1:{T.USEFUL_TERMS}]"


@query("scan_files", "select path, size, language from files")
def _(s, d):
    return table(s, d, "files").select("path", "size", "language")


@query("point_lookup_order", "select * from orders where o_orderkey = 7")
def _(s, d):
    return table(s, d, "orders").filter("o_orderkey = 7")


@query("index_scan_lineitem", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey between 100 and 130")
def _(s, d):
    return table(s, d, "lineitem").filter(F.col("l_orderkey").between(100, 130)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("name_index", "select p_name as name, count(*) as n, min(p_partkey) as first_id, max(p_partkey) as last_id from part group by p_name")
def _(s, d):
    return table(s, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_id"), F.max("p_partkey").alias("last_id"))


@query("generated_dir_prune", f"select distinct path from files where len(list_intersect(string_split(lower(path), '/'), {_list(C.GENERATED_DIRS)})) = 0")
def _(s, d):
    return table(s, d, "files").filter(~C.in_generated_dir(F.col("path"))).select("path").distinct()


_EXT = r"lower(regexp_extract(string_split(path, '/')[-1], '[^.]\.([^.]+)$', 1))"


@query("extension_filter", f"select distinct path from files where {_EXT} in {tuple(C.extensions())}")
def _(s, d):
    return table(s, d, "files").filter(C.is_supported(F.col("path"))).select("path").distinct()


@query("language_of_path", "select path, case " + " ".join(f"when {_EXT} in ({', '.join(repr(e) for e in v.split())}) then '{k}'" for k, v in C.LANGUAGES.items()) + " else 'Other' end as language from files")
def _(s, d):
    return table(s, d, "files").select("path", C.language_of(F.col("path")).alias("language"))


@query("layer_of_path", "select path, case " + " ".join("when " + " or ".join(f"contains(path, '{m}')" for m in ms) + f" then '{k}'" for k, ms in C.LAYERS) + " else 'core' end as layer from files")
def _(s, d):
    return table(s, d, "files").select("path", C.layer_of(F.col("path")).alias("layer"))


@query("module_of_path", "select path, case when len(string_split(path, '/')) <= 1 then '(root)' else array_to_string(string_split(path, '/')[greatest(1, len(string_split(path, '/')) - 2):len(string_split(path, '/')) - 1], '/') end as module from files")
def _(s, d):
    return table(s, d, "files").select("path", P.module_key(F.col("path")).alias("module"))


@query("find_files_terms", "select distinct path, len(string_split(path, '/')) as depth from files where contains(lower(path), 'parser') and contains(lower(path), 'graph')")
def _(s, d):
    df = table(s, d, "files").select("path").distinct()
    terms = F.array(F.lit("parser"), F.lit("graph"))
    return df.filter(F.forall(terms, lambda t: F.contains(F.lower("path"), t))).select("path", P.path_depth(F.col("path")).alias("depth"))


@query("list_files_page", "select distinct path from files order by path limit 50 offset 20")
def _(s, d):
    return table(s, d, "files").select("path").distinct().orderBy("path").offset(20).limit(50)


@query("count_tokens", r"select doc_id, cast(ceil(len(regexp_extract_all(text, '\S+')) * 13 / 10.0) as bigint) as tokens from documents where text is not null")
def _(s, d):
    return _docs(s, d).select("doc_id", T.count_tokens(F.col("text")).alias("tokens"))


@query("line_count", r"select doc_id, cast(case when text = '' then 0 when ends_with(text, chr(10)) then len(string_split(text, chr(10))) - 1 else len(string_split(text, chr(10))) end as bigint) as lines from documents where text is not null")
def _(s, d):
    return _docs(s, d).select("doc_id", T.line_count(F.col("text")).alias("lines"))


@query("code_tokens", f"select doc_id, md5(array_to_string({_CT.format('text')}, ' ')) as digest, len({_CT.format('text')}) as n from documents where text is not null")
def _(s, d):
    toks = T.code_tokens(F.col("text"))
    return _docs(s, d).select("doc_id", F.md5(F.array_join(toks, " ")).alias("digest"), F.size(toks).cast("long").alias("n"))


@query("useful_terms", f"select doc_id, {_useful(_CT.format('text'))} as terms from documents where text is not null")
def _(s, d):
    return _docs(s, d).select("doc_id", T.useful_terms(T.code_tokens(F.col("text"))).alias("terms"))


@query("relation_verbs", "select verb, case " + " ".join(f"when verb in {tuple(v)} then '{k}'" for k, v in T.RELATIONS.items()) + " end as relation from (select distinct lower(edge_type) as verb from edges union select unnest(['call', 'requires', 'inside', 'emits', 'other']))")
def _(s, d):
    a = table(s, d, "edges").select(F.lower("edge_type").alias("verb")).distinct()
    b = s.createDataFrame([(w,) for w in ("call", "requires", "inside", "emits", "other")], "verb string")
    return a.union(b).distinct().select("verb", T.relation_for(F.col("verb")).alias("relation"))


_SYN = "map {" + ", ".join(f"'{w}': {_list(to)}" for w, to in T.synonym_map().items()) + "}"
_CON = "map {" + ", ".join(f"'{w}': '{c}'" for w, c in T.concept_map().items()) + "}"


def _canon(x: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_transform({x}, lambda t: coalesce({_CON}[t], t)))), '+')"


@query(
    "query_intent",
    f"""with q as (select bundle_id, query, {_CT.format('query')} as toks from context_bundles),
    p as (select *, list_transform(toks, lambda t: list_contains({_list(T.relation_map())}, t)) as isrel from q),
    r as (select *, coalesce(list_position(isrel, true), 0) as rel_at from p),
    u as (select *, {_useful('toks')} as terms, case when rel_at > 0 then {_useful('toks[1:rel_at - 1]')} else [] end as subj, case when rel_at > 0 then {_useful('toks[rel_at + 1:]')} else [] end as obj from r),
    x as (select *, list_sort(list_distinct(list_concat(terms, flatten(list_transform(terms, lambda t: coalesce({_SYN}[t], []))))))[1:{T.EXPANDED_TERMS}] as expanded from u)
    select bundle_id, array_to_string(terms, ' ') as terms, concat(case when rel_at > 0 then lower(case {' '.join(f"when toks[rel_at] in {tuple(v)} then '{k}'" for k, v in T.RELATIONS.items())} end) else 'any' end, '|', {_canon('subj')}, '|', {_canon('obj')}, '|', array_to_string(expanded, '+')) as canonical from x""",
)
def _(s, d):
    a = T.analyze_query(F.col("query"))
    q = table(s, d, "context_bundles").select("bundle_id", a.alias("a"))
    return q.select("bundle_id", F.array_join("a.terms", " ").alias("terms"), "a.canonical")


@query("stopword_terms", f"select w as word, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from documents where text is not null) where w in {tuple(T.STOPWORDS)} group by w")
def _(s, d):
    w = _docs(s, d).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("word"))
    return w.filter(T.is_stopword(F.col("word"))).groupBy("word").agg(F.count("*").alias("n"))


@query("trigrams", "select p_partkey, case when length(p_name) < 3 then [] else list_transform(range(1, length(p_name) - 1), lambda i: substr(lower(p_name), i, 3)) end as grams from part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", T.trigrams(F.col("p_name")).alias("grams"))


@query("leaf_names", r"select distinct dst, case when contains(dst, '.') then string_split(dst, '.')[-1] else string_split(dst, '::')[-1] end as leaf, case when regexp_extract(dst, '([^.:/\\]+)[.:/\\]*$', 1) = '' then dst else regexp_extract(dst, '([^.:/\\]+)[.:/\\]*$', 1) end as part from edges where dst is not null")
def _(s, d):
    c = F.col("dst")
    return table(s, d, "edges").filter("dst is not null").select("dst").distinct().select("dst", T.leaf_name(c).alias("leaf"), T.path_leaf(c).alias("part"))


@query("body_slice", r"select doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) as body from documents where text is not null")
def _(s, d):
    t = F.col("text")
    return _docs(s, d).select("doc_id", T.body_slice(t, F.lit(2), F.lit(4)).alias("body"))


@query("line_col", r"select doc_id, len(string_split(left(text, 100), chr(10))) as line, length(string_split(left(text, 100), chr(10))[-1]) + 1 as col from documents where text is not null")
def _(s, d):
    lc = T.line_col(F.col("text"), F.lit(100))
    return _docs(s, d).select("doc_id", lc.alias("p")).select("doc_id", "p.line", "p.col")


@query("boundary_lines", r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents where text is not null), t as (select doc_id, regexp_replace(line, '^[\t\n\v\f\r\x{85}\p{Z}]+|[\t\n\v\f\r\x{85}\p{Z}]+$', '', 'g') as s from l)
select doc_id, count(*) filter (where s = '' or regexp_matches(s, '[};]$|^(match |if |for |while |try:|except )')) as boundaries from t group by doc_id""")
def _(s, d):
    lines = _docs(s, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(T.is_boundary(F.col("line"))).alias("boundaries"))


@query("bounded_text", "select doc_id, case when length(text) > 80 then concat(substr(text, 1, 80), '…') else text end as head from documents where text is not null")
def _(s, d):
    return _docs(s, d).select("doc_id", T.bounded_text(F.col("text"), 80).alias("head"))


@query("well_named", r"select distinct name, strlen(name) >= 8 and lower(name) not in ('main','run','get','set','new','init','data','item','value','handler') and regexp_matches(name, '_|\p{Ll}\p{Lu}') as ok from symbols where name is not null")
def _(s, d):
    return table(s, d, "symbols").filter("name is not null").select("name", T.is_well_named(F.col("name")).alias("ok")).distinct()


@query("elided_signatures", r"""select distinct kind, signature, case when kind in ('Function','Method','Impl','Class','Struct','Enum','Interface') then concat(trim(regexp_replace(signature, '\{+$', '')), ' { ... }') else signature end as shown from symbols where signature is not null""")
def _(s, d):
    return table(s, d, "symbols").filter("signature is not null").select("kind", "signature", T.elided_signature(F.col("kind"), F.col("signature")).alias("shown")).distinct()


@query("retrieval_text", "select distinct id, md5(concat_ws(chr(10), signature, nullif(docstring, ''), name)) as digest from symbols")
def _(s, d):
    return table(s, d, "symbols").select("id", F.md5(T.retrieval_text(F.col("signature"), F.col("docstring"), F.col("name"))).alias("digest")).distinct()


@query("entrypoints", r"select distinct id from symbols where lower(name) in ('main','app','application','server') or regexp_matches(file_path, '(main\.rs|main\.py|index\.ts|index\.js)$')")
def _(s, d):
    return table(s, d, "symbols").filter(C.is_entrypoint(F.col("name"), F.col("file_path"))).select("id").distinct()


@query("contracts", f"select id from symbols where kind in {tuple(C.CONTRACT_KINDS)} group by id")
def _(s, d):
    return table(s, d, "symbols").filter(C.is_contract(F.col("kind"))).select("id").distinct()


@query("kind_of_prefix", "select distinct name, case name " + " ".join(f"when '{k}' then '{v}'" for k, v in C.KIND_OF_PREFIX.items()) + " else 'Symbol' end as kind from (select lower(kind) as name from symbols where kind is not null union all select unnest(['func', 'mixin', 'tag']))")
def _(s, d):
    a = table(s, d, "symbols").filter("kind is not null").select(F.lower("kind").alias("name")).distinct()
    return a.union(s.createDataFrame([("func",), ("mixin",), ("tag",)], "name string")).distinct().select("name", C.kind_of_prefix(F.col("name")).alias("kind"))


@query("kind_counts", "select lower(trim(kind)) as kind, count(*) as n from symbols where kind is not null group by 1")
def _(s, d):
    return table(s, d, "symbols").filter("kind is not null").groupBy(F.lower(F.trim("kind")).alias("kind")).agg(F.count("*").alias("n"))


@query("edge_priority", """select edge_id, round(least(case edge_type when 'Inherits' then 1.0 when 'Calls' then 0.96 when 'Defines' then 0.94 when 'Imports' then 0.86 when 'References' then 0.78 when 'Contains' then 0.74 end
 * case when trace_id is not null or coalesce(list_contains(tags, 'execution-trace'), false) then 1.12 when coalesce(list_contains(tags, 'stack-graphs'), false) then 1.08 else 1.0 end, 1.1)::double, 6) as weight,
 case when trace_id is not null then concat('execution_trace:', trace_id) when coalesce(list_contains(tags, 'stack-graphs'), false) then 'stack_graph' when tags is null or len(tags) = 0 then 'ast_extracted' else array_to_string(tags, ',') end as evidence from edges""")
def _(s, d):
    e = table(s, d, "edges")
    return e.select("edge_id", F.round(C.edge_priority(F.col("edge_type"), F.col("tags"), F.col("trace_id")), 6).alias("weight"), C.edge_evidence(F.col("tags"), F.col("trace_id")).alias("evidence"))


@query("url_quote")
def _(s, d):
    return table(s, d, "files").select("path", T.url_quote(F.col("path")).alias("u")).distinct()


@query("html_blocks", r"select doc_id, len(regexp_extract_all(text, '(?is)<(?:script|style|template|noscript|center)([^>]*)>(.*?)</(?:script|style|template|noscript|center)>')) as blocks from documents where text is not null")
def _(s, d):
    pat = r"(?is)<(?:script|style|template|noscript|center)([^>]*)>(.*?)</(?:script|style|template|noscript|center)>"
    return _docs(s, d).select("doc_id", F.size(F.regexp_extract_all("text", F.lit(pat), 0)).cast("long").alias("blocks"))


@query("html_tags", r"select doc_id, list_filter(regexp_extract_all(text, '<([A-Za-z0-9_.:-]+)', 1), lambda t: contains(t, '-') or regexp_matches(t, '^[A-Z]')) as tags from documents where text is not null")
def _(s, d):
    tags = F.regexp_extract_all("text", F.lit("<([A-Za-z0-9_.:-]+)"), 1)
    return _docs(s, d).select("doc_id", F.filter(tags, lambda t: F.contains(t, F.lit("-")) | t.rlike("^[A-Z]")).alias("tags"))


@query("html_attr", r"""select doc_id, coalesce(nullif(regexp_extract(text, 'version\s*=\s*"([^"]*)"', 1), ''), nullif(regexp_extract(text, 'version\s*=\s*''([^'']*)''', 1), '')) as version from documents where text is not null""")
def _(s, d):
    a = F.nullif(F.regexp_extract("text", 'version\\s*=\\s*"([^"]*)"', 1), F.lit(""))
    b = F.nullif(F.regexp_extract("text", "version\\s*=\\s*'([^']*)'", 1), F.lit(""))
    return _docs(s, d).select("doc_id", F.coalesce(a, b).alias("version"))


@query("json_prop", "select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.expr("try_cast(get_json_object(props, '$.k') as bigint)").alias("k"))


@query("epoch_ms", "select event_id, epoch_us(ts) // 1000 as ms, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as rfc from events")
def _(s, d):
    t = F.col("ts").cast("timestamp")
    return table(s, d, "events").select("event_id", F.unix_millis(t).alias("ms"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("rfc"))


@query("event_type_clean", r"select event_id, case when left(regexp_replace(event_type, '[^A-Za-z0-9_]', '', 'g'), 48) = '' then 'unknown' else left(regexp_replace(event_type, '[^A-Za-z0-9_]', '', 'g'), 48) end as event_type from events")
def _(s, d):
    return table(s, d, "events").select("event_id", T.event_type(F.col("event_type")).alias("event_type"))


@query("regex_full", "select p_partkey from part where regexp_full_match(lower(p_name), '.*(red|blue).*')")
def _(s, d):
    return table(s, d, "part").filter(T.full_regex(F.col("p_name"), ".*(red|blue).*")).select("p_partkey")


@query("escape_terms", r"select p_partkey, regexp_replace(p_type, '[^\p{L}\p{N}_]', '', 'g') as term from part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", T.escape_term(F.col("p_type")).alias("term"))


@query("content_hash", "select doc_id, sha256(text) as digest from documents where text is not null")
def _(s, d):
    return _docs(s, d).select("doc_id", F.sha2("text", 256).alias("digest"))


@query("quantize_i8", "select vec_id, list_transform(embedding, lambda x: cast(round(least(greatest(x::double, -1.0), 1.0) * 127) as bigint)) as q from embeddings")
def _(s, d):
    return table(s, d, "embeddings").select("vec_id", V.quantize_i8(F.col("embedding")).alias("q"))


@query("quantize_b1", "select vec_id, list_transform(embedding, lambda x: cast(x > 0 as bigint)) as q from embeddings")
def _(s, d):
    return table(s, d, "embeddings").select("vec_id", V.quantize_b1(F.col("embedding")).alias("q"))


@query("cosine_to_first", "select e.vec_id, round(list_cosine_similarity(e.embedding::double[], f.embedding::double[]), 5) as score from embeddings e, (select embedding from embeddings where vec_id = (select min(vec_id) from embeddings)) f")
def _(s, d):
    e = table(s, d, "embeddings")
    first = e.orderBy("vec_id").limit(1).first()["embedding"]
    q = F.array(*[F.lit(float(x)) for x in first])
    return e.select("vec_id", F.round(V.cosine(F.col("embedding"), q), 5).alias("score"))


@query("mean_pool_by_label", "select label, i, round(avg(x), 6) as mean from (select label, unnest(range(1, 65)) as i, unnest(embedding)::double as x from embeddings) group by label, i")
def _(s, d):
    e = table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return e.groupBy("label", (F.col("i") + 1).cast("long").alias("i")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("hash_embedding")
def _(s, d):
    return _docs(s, d).select("doc_id", V.hash_embedding(F.col("text"), 16).alias("vec"))


@query("match_text_ops", "select p_partkey from part where p_type = 'ECONOMY' or contains(lower(p_name), 're') and starts_with(lower(p_brand), 'brand') and ends_with(lower(p_name), 'e')")
def _(s, d):
    p = table(s, d, "part")
    return p.filter((F.col("p_type") == "ECONOMY") | (F.lower("p_name").contains("re") & F.lower("p_brand").startswith("brand") & F.lower("p_name").endswith("e"))).select("p_partkey")


@query("row_format", "select p_partkey, concat_ws(chr(9), p_name, p_brand, p_size) as line from part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.concat_ws("\t", "p_name", "p_brand", F.col("p_size").cast("string")).alias("line"))


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
