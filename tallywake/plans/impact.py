"""Impact ranking over the documents table as a corpus and the benchmark items as requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywake.functions import fixed_values as fixed
from tallywake.functions import paths as P
from tallywake.operators import impact as m
from tallywake.operators import terms as t
from tallywake.plans.tables import spread, table
from tallywake.session import written

# A document is a file: its lines are symbols, its first word an export and part of its path.
DOC_PATH = """concat(case lang when 'en' then 'src/services/' when 'fr' then 'scripts/' when 'de' then 'tests/' else 'docs/' end,
  case when doc_id % 3 = 0 then 'auth/' when doc_id % 3 = 1 then 'billing/' else 'lib/' end,
  lower(coalesce(nullif(regexp_extract(text, '([A-Za-z]+)', 1), ''), 'empty')), '-', cast(doc_id as varchar(20)),
  case when doc_id % 7 = 0 then '.service.ts' when doc_id % 7 = 1 then '.md' when lang = 'de' then '.test.ts' else '.ts' end)"""
REQUEST_TEXT = """concat(text, case item_id % 4 when 0 then ' fix login sessions in OpenPanel docs' when 1 then ' update checkout payments env docker config tests'
  when 2 then ' rename refunds refund migrations' else '' end)"""


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "lang", F.col("source").alias("repo_id"), F.expr(DOC_PATH).alias("path"), "text")
    line_type = lambda i: F.when(i % 2 == 0, "method").otherwise("function")
    symbols = F.transform(F.split("text", "\n"), lambda line, i: F.struct(line.alias("name"), line_type(i).alias("type")))
    p = F.col("path")
    return docs.select(
        "doc_id", "repo_id", "path", P.kind(p).alias("kind"), F.col("lang").alias("domain"), F.lit(None).cast("string").alias("route"),
        F.lit(None).cast("string").alias("controller"), F.lit(False).alias("is_vendor"), symbols.alias("symbols"),
        F.array(F.lower(F.regexp_extract("text", "([A-Za-z]+)", 1))).alias("exports"), F.array().cast("array<string>").alias("imports"),
    )


def doc_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("request_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("repo_id"), F.expr(REQUEST_TEXT).alias("text")
    )


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_tokens(x: str) -> str:
    spaced = f"regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')"
    return f"list_filter(string_split(lower({spaced}), ' '), lambda w: w <> '' and w not in {tuple(fixed.IMPACT_STOP_WORDS)})"


def sql_singular(w: str) -> str:
    return (
        f"case when length({w}) <= 3 or {w} like '%ss' then {w} when {w} like '%ies' then {w}[:-4] || 'y'"
        f" when regexp_matches({w}, '(s|x|z|ch|sh)es$') then {w}[:-3] when {w} like '%s' then {w}[:-2] else {w} end"
    )


FILES_CTE = f"""
files as (select doc_id, source as repo_id, {DOC_PATH} as path, lang as domain, text, lower(regexp_extract(text, '([A-Za-z]+)', 1)) as export from documents),
kinded as (select *, regexp_matches(path, '(^|/)tests(/|$)|\\.test\\.ts$') as is_test from files),
kinds as (select *, case when is_test then 'test' when path like '%.md' then 'doc' when path like '%.service.ts' then 'service'
    when path like 'src/services/%' then 'apiClient' else 'source' end as kind from kinded),
requests as (select item_id as request_id, 'src' || (item_id % 20) as repo_id, {REQUEST_TEXT} as text from benchmark)
"""
TERMS_CTE = f"""
rtok as (select request_id, unnest({sql_tokens('text')}) as term, generate_subscripts({sql_tokens('text')}, 1) as pos from requests),
own as (select request_id, term, min(pos) as pos, count(*) + case when length(term) >= 6 then 1 else 0 end
    + case when term in {tuple(fixed.DOMAIN_KEYWORDS)} then 2 else 0 end as weight from rtok group by 1, 2),
fold as (select request_id, {sql_singular('term')} as term, pos, greatest(1, weight - 1) as weight from own where length(term) > 4 and {sql_singular('term')} <> term),
camel as (select distinct request_id, lower(w) as term from (select request_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) as w from requests) where regexp_matches(w, '[a-z0-9][A-Z]')),
merged as (select coalesce(o.request_id, f.request_id) as request_id, coalesce(o.term, f.term) as term, greatest(o.weight, f.weight) as weight
   from own o full join (select f.request_id, f.term, max(f.weight) as weight from fold f left join own o on o.request_id = f.request_id and o.term = f.term
        where o.pos is null or f.pos > o.pos group by 1, 2) f on o.request_id = f.request_id and o.term = f.term),
rterms as (select request_id, term, cast(weight as bigint) as weight from merged
   union all select request_id, term, case when length(term) >= 6 then 2 else 1 end from camel where (request_id, term) not in (select (request_id, term) from merged)),
wanted as (select r.repo_id, t.* from rterms t join requests r using (request_id))
"""
FREQ_CTE = f"""
fterms as (select distinct repo_id, path, unnest({sql_tokens("concat_ws(' ', path, kind, domain, export, text)")}) as term from kinds),
df as (select f.repo_id, f.term, count(*) as df from fterms f where (f.repo_id, f.term) in (select (repo_id, term) from wanted) group by 1, 2),
totals as (select repo_id, count(*) as total from kinds group by 1),
freq as (select repo_id, term, df, total, case when df * 1.0 / total <= 0.02 then 1.4 when df * 1.0 / total <= 0.06 then 1.0
    when df * 1.0 / total <= 0.15 then 0.55 else 0.2 end::double as factor from df join totals using (repo_id))
"""
CONCEPTS = list(fixed.CONCEPT_WORDS)


def _concept_sql(tokens: str) -> str:
    parts = []
    for concept, vocabulary in fixed.CONCEPT_WORDS.items():
        single = [w for w in vocabulary if " " not in w and "-" not in w]
        runs = sorted({" ".join(w.replace("-", " ").split()) for w in vocabulary if w not in single})
        with_singular = f"list_concat({tokens}, list_transform({tokens}, lambda w: {sql_singular('w')}))"
        tests = [f"list_has_any({with_singular}, {_list(single)})"] + [f"contains(' ' || array_to_string({tokens}, ' ') || ' ', ' {r} ')" for r in runs]
        parts.append(f"case when {' or '.join(tests)} then '{concept}' end")
    return "list_filter([" + ", ".join(parts) + "], lambda x: x is not null)"


RAW_CONCEPT_TOKENS = "list_filter(string_split_regex(lower(text), '[^a-z0-9-]+'), lambda w: w <> '')"
CONCEPT_TOKENS = f"""flatten(list_transform({RAW_CONCEPT_TOKENS},
   lambda w: case when contains(w, '-') then list_concat([w], list_filter(string_split(w, '-'), lambda x: x <> '')) else [w] end))"""
PROFILE_CTE = f"""
ctok as (select *, {CONCEPT_TOKENS} as ct from requests),
profile as (select request_id, repo_id, {_concept_sql('ct')} as concepts,
   (select list(term) from rterms t where t.request_id = ctok.request_id) as terms from ctok)
"""
HAY = "lower(text || chr(10) || export)"
FILE_CONCEPTS = "list_filter([" + ", ".join(
    f"case when regexp_matches({HAY}, '{'|'.join(w)}')"
    + {"auth/security": " or path like '%/auth/%'", "money flow": " or path like '%/billing/%'", "request surface": "", "data model": "", "configuration": "", "dependency": ""}[c]
    + (
        " or list_has_any(list_concat(string_split_regex(lower(path), '[^a-z0-9]+'), list_transform(string_split_regex(lower(path), '[^a-z0-9]+'), lambda w: "
        + sql_singular("w")
        + f")), {_list({'auth/security': fixed.AUTH_WORDS + ['token'], 'money flow': fixed.MONEY_WORDS, 'data model': fixed.DATA_MODEL_WORDS, 'configuration': fixed.CONFIG_WORDS}.get(c, ['~']))})"
    )
    + f" then '{c}' end"
    for c, w in fixed.CONCEPT_WORDS.items()
) + "], lambda x: x is not null)"
HINTS = "list_filter([" + ", ".join(
    f"case when list_contains(terms, '{term}') and ({' or '.join(f'contains(lower(f.path), {chr(39)}{h}{chr(39)})' for h in hints)}) then 1 end" for term, hints in fixed.CONFIG_HINTS.items()
) + "], lambda x: x is not null)"
R1_CTE = f"""{FILES_CTE}, {TERMS_CTE}, {FREQ_CTE}, {PROFILE_CTE},
fields as (select repo_id, path, unnest(list_distinct({sql_tokens("regexp_replace(path, '[.][A-Za-z0-9]+$', '')")})) as term, 9.0 as w from kinds
  union all select repo_id, path, unnest(list_distinct({sql_tokens('text')})), 5.0 from kinds
  union all select repo_id, path, unnest(list_distinct({sql_tokens('export')})), 4.0 from kinds),
ftw as (select repo_id, path, term, sum(w)::double as w from fields group by 1, 2, 3),
hit as (select w.request_id, f.repo_id, f.path, sum(w.weight * coalesce(q.factor, 1.0) * f.w) as text from wanted w join ftw f on f.repo_id = w.repo_id and f.term = w.term
   left join freq q on q.repo_id = w.repo_id and q.term = w.term group by 1, 2, 3),
fc as (select repo_id, path, kind, {FILE_CONCEPTS} as concepts from kinds),
pairs as (select p.request_id, p.repo_id, f.path, f.kind, coalesce(h.text, 0) as text, len(p.concepts) as nc, len(list_intersect(p.concepts, f.concepts)) as implied,
    len({HINTS}) as hints, p.terms, h.text is not null as direct
  from profile p join fc f on f.repo_id = p.repo_id left join hit h on h.request_id = p.request_id and h.repo_id = f.repo_id and h.path = f.path),
scored0 as (select *, (case when implied > 0 then text * 1.4 + 6.0 * implied when nc > 0 then text * (case when nc <= 1 then 0.5 else least(0.8, 0.5 + 0.15 * (nc - 1)) end) else text end + 4.0 * hints)
   * (case when kind = 'test' then case when list_has_any(terms, ['test', 'tests', 'spec', 'coverage', 'qa']) then 0.9 else 0.45 end else 1.0 end)
   * (case when path like 'scripts/%' then 0.55 when path like 'docs/%' and not list_has_any(terms, ['doc', 'docs', 'documentation', 'readme', 'changelog']) then 0.6 else 1.0 end)
   * (case when kind in ('service', 'apiClient', 'doc') then 1.15 else 1.0 end) as s from pairs),
scored as (select request_id, repo_id, path, kind, floor(s * 1000000.0 + 0.5) / 1000000.0 as score, direct from scored0 where s > 0.0000005)
"""


def r2_weighted_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.weighted_terms(doc_requests(spark, sf_dir))


R2_SQL = f"with {FILES_CTE}, {TERMS_CTE} select * from rterms"


def a23_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, requests = doc_files(spark, sf_dir), doc_requests(spark, sf_dir)
    wanted = t.weighted_terms(requests).join(requests.select("request_id", "repo_id"), "request_id")
    return t.document_frequency(m.file_frequency_terms(files), wanted, files)


A23_SQL = f"with {FILES_CTE}, {TERMS_CTE}, {FREQ_CTE} select * from freq"


def p7_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text").unionByName(
        doc_requests(spark, sf_dir).select((F.col("request_id") + 100_000_000).alias("doc_id"), "text")
    )
    return docs.select("doc_id", F.array_join(t.concepts(F.col("text")), "|").alias("concepts"))


P7_SQL = f"""with a as (select doc_id, text from documents union all select item_id + 100000000, {REQUEST_TEXT} from benchmark),
tok as (select doc_id, {CONCEPT_TOKENS} as ct from a) select doc_id, coalesce(array_to_string({_concept_sql('ct')}, '|'), '') as concepts from tok"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.score_files(doc_requests(spark, sf_dir), doc_files(spark, sf_dir))


def r1_impact_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.top_files(scored(spark, sf_dir), 10).select("request_id", "repo_id", "path", "score", "rank")


R1_SQL = f"with {R1_CTE} select * from (select request_id, repo_id, path, score, row_number() over (partition by request_id order by score desc, repo_id, path) as rank from scored) where rank <= 10"


def r10_companion_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same request in three companion repositories of its own, top three each."""
    own = doc_requests(spark, sf_dir)
    number = F.regexp_extract("repo_id", "([0-9]+)", 1).cast("int")
    others = own.select("request_id", "text", F.explode(F.array(*[F.concat(F.lit("src"), ((number + i) % 20).cast("string")) for i in (1, 2, 3)])).alias("repo_id"))
    keyed = others.withColumn("request_id", F.concat_ws("@", F.col("request_id").cast("string"), F.col("repo_id")))
    ranked = m.top_files(m.score_files(keyed, doc_files(spark, sf_dir)), 3, ("request_id", "repo_id"))
    return ranked.select("request_id", "repo_id", "path", "score", "rank")


R10_SQL = "with " + R1_CTE.replace(
    f"requests as (select item_id as request_id, 'src' || (item_id % 20) as repo_id, {REQUEST_TEXT} as text from benchmark)",
    f"requests as (select item_id || '@src' || ((item_id % 20 + i) % 20) as request_id, 'src' || ((item_id % 20 + i) % 20) as repo_id, {REQUEST_TEXT} as text from benchmark, (values (1), (2), (3)) v(i))",
) + " select * from (select request_id, repo_id, path, score, row_number() over (partition by request_id order by score desc, repo_id, path) as rank from scored) where rank <= 3"

# Edges between documents of one repository: each imports the files at a third and a fifth of its place.
EDGE_CTE = """
placed as (select repo_id, path, kind, row_number() over (partition by repo_id order by doc_id) as k from kinds),
ed as (select a.repo_id, a.path as src, b.path as dst from placed a join placed b on b.repo_id = a.repo_id and b.k in (a.k // 3, a.k // 5) and a.k <> b.k)
"""


def doc_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, repo_id, path, kind, domain) of ``doc_files``, worked out and written once: many joins read it."""
    return written(doc_files(spark, sf_dir).select("doc_id", "repo_id", "path", "kind", "domain"), "names")


def doc_edges(spark: SparkSession, sf_dir: str, files: DataFrame | None = None) -> DataFrame:
    """files: ``doc_names``, where the caller has them."""
    from tallywake.functions.slices import with_running

    f = (doc_files(spark, sf_dir) if files is None else files).select("repo_id", "path", "doc_id", F.floor(F.col("doc_id") / 1000).alias("slice"))
    placed = with_running(f, ["repo_id"], "slice", ["doc_id"], sums={"k": F.lit(1)}).select("repo_id", "path", "k")
    targets = placed.select("repo_id", F.col("path").alias("dst"), F.col("k").alias("kk"))
    each = placed.select("repo_id", F.col("path").alias("src"), "k", F.explode(F.array_distinct(F.array(F.floor(F.col("k") / 3), F.floor(F.col("k") / 5)))).alias("kk"))
    return each.join(targets, ["repo_id", "kk"]).where("src <> dst").select("repo_id", "src", "dst")


def j7_import_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.boost_imports(scored(spark, sf_dir), doc_edges(spark, sf_dir))


BOOST_CTE = f"""{R1_CTE}, {EDGE_CTE},
seed as (select request_id, repo_id, path as src, least(score * 0.16, 8.0) as gain from (select *, row_number() over (partition by request_id order by score desc, repo_id, path) as n from scored) where n <= 15),
gain as (select s.request_id, s.repo_id, e.dst as path, sum(s.gain) as gain from seed s join ed e on e.repo_id = s.repo_id and e.src = s.src group by 1, 2, 3)
"""
J7_SQL = f"""with {BOOST_CTE}
select coalesce(s.request_id, g.request_id) as request_id, coalesce(s.repo_id, g.repo_id) as repo_id, coalesce(s.path, g.path) as path,
  floor((coalesce(s.score, 0) + coalesce(g.gain, 0)) * 1000000.0 + 0.5) / 1000000.0 as score, g.gain is not null as boosted
from scored s full join gain g on g.request_id = s.request_id and g.repo_id = s.repo_id and g.path = s.path"""


def naming_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that write out a path of their repository, in several styles."""
    f = doc_files(spark, sf_dir)
    tail = F.regexp_extract("path", "([^/]+)$", 1)
    style = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("`"), F.col("path"), F.lit("`,"))).when(F.col("doc_id") % 3 == 1, F.concat(tail, F.lit(":12"))).otherwise(
        F.regexp_replace("path", r"\.ts$", ".js"))
    return f.select(F.col("doc_id").alias("request_id"), "repo_id", F.concat(F.lit("look at "), style, F.lit(" and 'util/none' please, see https://x.example/a.ts")).alias("text"))


def j8_named_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.named_paths(naming_requests(spark, sf_dir), doc_files(spark, sf_dir)).select("request_id", "repo_id", "path")


J8_SQL = f"""with {FILES_CTE},
ask as (select doc_id as request_id, repo_id, lower(case doc_id % 3 when 0 then path when 1 then regexp_extract(path, '([^/]+)$', 1) else regexp_replace(path, '\\.ts$', '.js') end) as lit from files),
ex as (select a.request_id, a.repo_id, f.path from ask a join files f on f.repo_id = a.repo_id and (lower(f.path) = a.lit or ends_with(lower(f.path), '/' || a.lit))),
st as (select a.request_id, a.repo_id, f.path from ask a join files f on f.repo_id = a.repo_id and
   (regexp_replace(lower(f.path), '\\.[^./]+$', '') = regexp_replace(a.lit, '\\.[^./]+$', '') or ends_with(regexp_replace(lower(f.path), '\\.[^./]+$', ''), '/' || regexp_replace(a.lit, '\\.[^./]+$', '')))),
both_forms as (select * from ex union all select * from st where request_id not in (select request_id from ex))
select * from both_forms where request_id in (select request_id from both_forms group by 1 having count(*) <= 3)"""


def turn_of(number: str) -> Column:
    """The two requests of a repository take its files in turn."""
    return F.floor(F.expr(number)).cast("bigint") % 2


def w10_lift_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = doc_files(spark, sf_dir)
    rule = F.when(F.col("doc_id") % 3 == 0, "path").when(F.col("doc_id") % 3 == 1, "symbol").otherwise("dependency")
    pinned = doc_requests(spark, sf_dir).select("request_id", "repo_id", turn_of("request_id / 20").alias("turn")).join(f.select("repo_id", "path", rule.alias("rule"), turn_of("doc_id").alias("turn")), ["repo_id", "turn"]).drop("turn")
    out = m.lift_pinned(scored(spark, sf_dir), pinned)
    return out.select("request_id", "repo_id", "path", F.floor(F.col("score") * 1000 + 0.5).alias("milli"), "rule")


W10_SQL = f"""with {R1_CTE},
pin as (select r.request_id, r.repo_id, f.path, case f.doc_id % 3 when 0 then 'path' when 1 then 'symbol' else 'dependency' end as rule from requests r join files f on f.repo_id = r.repo_id and f.doc_id % 2 = (r.request_id // 20) % 2),
b as (select coalesce(s.request_id, p.request_id) as request_id, coalesce(s.repo_id, p.repo_id) as repo_id, coalesce(s.path, p.path) as path, coalesce(s.score, 0) as score, p.rule
  from scored s full join pin p on p.request_id = s.request_id and p.repo_id = s.repo_id and p.path = s.path),
c as (select request_id, coalesce(max(case when rule is null then score end), 0) as ceiling from b group by 1)
select request_id, repo_id, path, cast(floor((case when rule is not null then greatest(score, ceiling) + case rule when 'path' then 20 when 'symbol' then 10 else 5 end else score end) * 1000 + 0.5) as bigint) as milli, rule
from b join c using (request_id)"""


def r6_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = doc_files(spark, sf_dir)
    edges = doc_edges(spark, sf_dir)
    ends = edges.select("repo_id", F.explode(F.array(F.struct(F.col("dst").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    degrees = ends.groupBy("repo_id", F.col("e.path").alias("path")).agg(F.sum("e.i").alias("importers"), F.sum("e.o").alias("imports"))
    out = m.roles(scored(spark, sf_dir), doc_requests(spark, sf_dir), edges, degrees, files)
    return out.select("request_id", "path", "role")


R6_SQL = f"""with {R1_CTE}, {EDGE_CTE},
sw as (select request_id, list_has_any(terms, {_list(fixed.BOUNDARY_WORDS)}) as boundary, list_has_any(terms, {_list(fixed.SKILL_WORDS)}) as skills, list_has_any(terms, {_list(fixed.OWNER_DOC_WORDS)}) as docs, terms from profile),
r as (select s.*, sw.*  exclude (request_id), s.direct and kind in ('service', 'apiClient', 'doc') and (boundary or kind <> 'apiClient') and (kind <> 'doc' or docs) as conv,
    s.direct and kind <> 'test' and kind <> 'doc' and path not like 'docs/%' as gen from scored s join sw using (request_id)),
g as (select request_id, max(case when gen then score end) as best from r group by 1),
pool as (select r.*, row_number() over (partition by r.request_id order by score desc, path) as n, max(score) over (partition by r.request_id) as top from r join g using (request_id) where conv or (gen and coalesce(best, 0) >= 20)),
chosen as (select request_id, repo_id, path from pool where n <= 3 and score >= top * 0.8),
keys as (select distinct repo_id, path, what, term from (select repo_id, path, 'name' as what, string_split(regexp_extract(path, '([^/]+)$', 1), '.')[1] as term from kinds where kind not in ('test', 'doc') and path not like 'docs/%'
    union all select repo_id, path, 'export', export from kinds where kind not in ('test', 'doc') and path not like 'docs/%')),
sole as (select repo_id, what, term, min(path) as path from keys group by 1, 2, 3 having count(*) = 1),
ask as (select request_id, repo_id, unnest(terms) as term from profile),
imp as (select repo_id, dst as path, count(*) as importers from ed group by 1, 2),
lnk as (select repo_id, dst as path from ed union select repo_id, src from ed),
anc as (select distinct a.request_id, a.repo_id, o.path, coalesce(i.importers, 0) as importers, s.score from ask a join sole o on o.repo_id = a.repo_id and o.term = a.term join lnk l on l.repo_id = o.repo_id and l.path = o.path
   join scored s on s.request_id = a.request_id and s.repo_id = o.repo_id and s.path = o.path left join imp i on i.repo_id = o.repo_id and i.path = o.path
   where length(a.term) >= 3 and a.term not in {tuple(fixed.GRAPH_ANCHOR_STOP_TERMS)} and a.request_id not in (select request_id from chosen)),
req as (select * from chosen union select request_id, repo_id, path from (select *, row_number() over (partition by request_id order by importers desc, score desc, path) as n from anc) where n <= 3),
tpl as (select s.request_id, k.path from sw s join requests r using (request_id) join kinds k on k.repo_id = r.repo_id where list_has_any(s.terms, {_list(fixed.TEMPLATE_WORDS)}) and k.kind = 'test' and list_has_any(s.terms, {sql_tokens('k.path')})),
sup as (select q.request_id, e.dst as path from req q join ed e on e.repo_id = q.repo_id and e.src = q.path union select q.request_id, e.src from req q join ed e on e.repo_id = q.repo_id and e.dst = q.path union select * from tpl),
every as (select request_id, path, 0 as r from req union all select request_id, path, 1 from sup union all select request_id, path, 2 from scored)
select request_id, path, case min(r) when 0 then 'required' when 1 then 'supporting' else 'advisory' end as role from every group by 1, 2"""


def r7_collapse_locales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as ranked catalogue files, longest first within a host: /fr/12 and /en/12 fold together."""
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^https?://(?:[a-z]+\.)?([a-z-]+)\.example", 1)
    path = F.concat(F.lit("messages/"), F.regexp_replace(F.regexp_replace("url", r"^https?://[^/]*/", ""), r"/?\d*[./?#].*$|/\d+$", ""), F.lit("/common.json"))
    ranked = pages.select(
        F.lit(1).alias("request_id"), host.alias("repo_id"), path.alias("path"), F.lit("translation").alias("kind"), (F.length("html") * 1000 - F.col("page_id")).alias("score")
    ).groupBy("request_id", "repo_id", "path", "kind").agg(F.max("score").alias("rank"))
    return m.collapse_locales(ranked.withColumn("rank", -F.col("rank"))).select("repo_id", "path", F.size("siblings").alias("siblings"), F.array_join("siblings", ",").alias("folded"))


R7_SQL = r"""with p as (select regexp_extract(url, '^https?://(?:[a-z]+\.)?([a-z-]+)\.example', 1) as repo_id,
  'messages/' || regexp_replace(regexp_replace(url, '^https?://[^/]*/', ''), '/?\d*[./?#].*$|/\d+$', '') || '/common.json' as path, min(page_id - length(html) * 1000) as rank from pages group by 1, 2),
c as (select *, case when regexp_matches(path, '^messages/[a-z][a-z]/') then 'messages/*/common.json' end as cat from p),
h as (select repo_id, cat, min(rank) as head from c where cat is not null group by 1, 2)
select c.repo_id, c.path, coalesce((select count(*) from c o where o.repo_id = c.repo_id and o.cat = c.cat and o.path <> c.path), 0) as siblings,
  coalesce((select string_agg(o.path, ',' order by o.path) from c o where o.repo_id = c.repo_id and o.cat = c.cat and o.path <> c.path), '') as folded
from c left join h on h.repo_id = c.repo_id and h.cat = c.cat where c.cat is null or c.rank = h.head"""


def j22_merge_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = doc_files(spark, sf_dir)
    changed = doc_requests(spark, sf_dir).select("request_id", "repo_id", turn_of("request_id / 20").alias("turn")).join(
        f.select("repo_id", turn_of("doc_id").alias("turn"), F.when(F.col("doc_id") % 3 == 0, F.col("path")).otherwise(F.concat(F.lit("gone/"), F.col("path"))).alias("path")), ["repo_id", "turn"]).drop("turn")
    return m.merge_diff(scored(spark, sf_dir), changed, doc_files(spark, sf_dir)).select("request_id", "path", "section", "position")


J22_SQL = f"""with {R1_CTE},
ch as (select r.request_id, r.repo_id, case when f.doc_id % 3 = 0 then f.path else 'gone/' || f.path end as path from requests r join files f on f.repo_id = r.repo_id and f.doc_id % 2 = (r.request_id // 20) % 2),
b as (select coalesce(s.request_id, c.request_id) as request_id, coalesce(s.path, c.path) as path, coalesce(s.score, 0) as score,
   case when c.path is null then 'ranked' when f.path is not null then 'changed' else 'unmapped' end as section
  from scored s full join ch c on c.request_id = s.request_id and c.repo_id = s.repo_id and c.path = s.path left join files f on f.repo_id = c.repo_id and f.path = c.path)
select request_id, path, section, row_number() over (partition by request_id, section order by score desc, path) as position from b"""


def j24_related_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = m.top_files(scored(spark, sf_dir), 10)
    return m.related_tests(ranked, doc_files(spark, sf_dir)).select("request_id", "repo_id", "test", "overlap", "position")


KEPT = f"length(x) > 2 and x not in {tuple(fixed.TEST_MATCH_STOP_TERMS)}"
J24_SQL = f"""with {R1_CTE},
top as (select * from (select *, row_number() over (partition by request_id order by score desc, repo_id, path) as n from scored) where n <= 10),
w as (select distinct t.request_id, t.repo_id, unnest(list_filter(list_concat({sql_tokens('k.path')}, {sql_tokens("array_to_string(string_split(k.text, chr(10)), ' ')")}), lambda x: {KEPT})) as term
   from top t join kinds k on k.repo_id = t.repo_id and k.path = t.path),
tt as (select repo_id, path, unnest(list_distinct(list_filter({sql_tokens('path')}, lambda x: {KEPT}))) as term from kinds where kind = 'test' and regexp_matches(path, '\\.ts$')),
s as (select w.request_id, w.repo_id, tt.path as test, count(*) as overlap from w join tt on tt.repo_id = w.repo_id and tt.term = w.term group by 1, 2, 3)
select * from (select *, row_number() over (partition by request_id, repo_id order by overlap desc, test) as position from s) where position <= 8"""


QUERIES = {
    "r2_weighted_terms": (r2_weighted_terms, R2_SQL),
    "a23_document_frequency": (a23_document_frequency, A23_SQL),
    "p7_concepts": (p7_concepts, P7_SQL),
    "r1_impact_ranking": (r1_impact_ranking, R1_SQL),
    "r10_companion_leads": (r10_companion_leads, R10_SQL),
    "j7_import_boost": (j7_import_boost, J7_SQL),
    "j8_named_paths": (j8_named_paths, J8_SQL),
    "w10_lift_pinned": (w10_lift_pinned, W10_SQL),
    "r6_roles": (r6_roles, R6_SQL),
    "r7_collapse_locales": (r7_collapse_locales, R7_SQL),
    "j22_merge_diff": (j22_merge_diff, J22_SQL),
    "j24_related_tests": (j24_related_tests, J24_SQL),
}
