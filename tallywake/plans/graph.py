"""Path features and import graph over files derived from the part table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywake.functions import paths as P
from tallywake.functions.fixed_values import LANGUAGE_CODES
from tallywake.operators import graph as g
from tallywake.plans.tables import spread, table
from tallywake.session import shuffled, written

# The same expressions run on both engines: a path for every part.
FOLDER = """case p_type when 'ECONOMY' then 'src/services/' when 'LARGE' then 'src/app/api/' when 'MEDIUM' then 'tests/'
 when 'PROMO' then 'docs/' when 'SMALL' then 'config/' else 'src/lib/' end"""
AREA = """case p_size % 12 when 0 then 'auth' when 1 then 'sessions' when 2 then 'billing' when 3 then 'checkout' when 4 then 'users'
 when 5 then 'tokens' when 6 then 'locales/fr' when 7 then 'orders' when 8 then 'schemas' when 9 then 'fixtures' when 10 then 'skills' else 'vendor' end"""
ENDING = """case p_partkey % 14 when 0 then '.ts' when 1 then '.tsx' when 2 then '.js' when 3 then '.md' when 4 then '.sql' when 5 then '.json'
 when 6 then '.controller.ts' when 7 then '.test.ts' when 8 then '.go' when 9 then '.service.ts' when 10 then '/index.ts'
 when 11 then '/route.ts' when 12 then '/page.tsx' else '.en-GB.yml' end"""
PATH_SQL = f"""concat({FOLDER}, {AREA}, '/', case when p_size > 40 then upper(substr(p_name, 1, 1)) else substr(p_name, 1, 1) end,
 replace(substr(p_name, 2), ' ', '-'), '-', cast(p_partkey as varchar(20)), {ENDING})"""

SPECIAL_SQL = """case p_partkey % 10 when 0 then 'package.json' when 1 then '.env.local' when 2 then 'certs/server.pem' when 3 then 'web/Dockerfile.dev'
 when 4 then '.github/workflows/ci.yml' when 5 then 'secrets/prod.txt' when 6 then '.husky/pre-commit' when 7 then '.nvmrc'
 when 8 then 'app/(shop)/item/[id]/page.tsx' else 'CHANGELOG.md' end"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's path, plus a root-level special name per part under its brand."""
    part = spread(table(spark, sf_dir, "part"))
    rows = part.select(F.col("p_partkey").alias("id"), F.expr(PATH_SQL).alias("path"), (F.col("p_size") * 10).alias("changed_lines"))
    special = part.select((-F.col("p_partkey") - 1).alias("id"), F.expr(SPECIAL_SQL).alias("path"), F.lit(0).alias("changed_lines"))
    return rows.unionByName(special)


PATHS_CTE = f"""
paths as (select p_partkey as id, {PATH_SQL} as path, p_size * 10 as changed_lines from part
          union all select -p_partkey - 1, {SPECIAL_SQL}, 0 from part),
base as (select *, regexp_extract(path, '([^/]*)$', 1) as name, string_split(lower(path), '/') as segs,
           regexp_matches(path, '(^|/)(__tests__|test|tests|__snapshots__|snapshots)(/|$)|\\.(spec|test)\\.[jt]sx?$|\\.snap$|(^|/)[^/]+_test\\.go$') as is_test
         from paths),
kinds as (select *, case
   when regexp_matches(path, '(^|/)\\.(githooks|husky)/(pre-commit|pre-push|commit-msg|post-merge)(\\.sh)?$') then 'gitHook'
   when is_test then 'test'
   when regexp_matches(name, '(?i)\\.(hbs|handlebars)$') then 'template'
   when regexp_matches(path, '(?i)(^|/)(i18n|locale|locales|translations|messages|languages)(/|$)') and regexp_matches(name, '(?i)\\.(json|ya?ml)$') then 'translation'
   when regexp_matches(name, '(?i)\\.(json|ya?ml)$') and regexp_matches(path, '(?i)feature[-_]?flag|flags|config|environment|settings') then 'config'
   when regexp_matches(name, '(?i)^changelog(\\.[a-z0-9_-]+)?\\.md$') then 'changelog'
   when regexp_matches(name, '(?i)\\.(md|mdx|markdown)$') and (lower(name) = 'skill.md' or list_contains(segs[1:len(segs)-1], 'skills')) then 'skill'
   when regexp_matches(name, '(?i)\\.(md|mdx|markdown|rst|adoc)$') then 'doc'
   when regexp_matches(path, '(^|/)app/api/.*/route\\.[cm]?[jt]s$') then 'apiRoute'
   when name in ('page.tsx', 'page.ts', 'layout.tsx', 'layout.ts') then 'route'
   when name like '%.controller.ts' then 'controller' when name like '%.service.ts' then 'service' when name like '%.module.ts' then 'module'
   when name like '%.dto.ts' then 'dto' when name like '%.schema.ts' or path like '%/schemas/%' then 'schema'
   when regexp_matches(name, '(?i)\\.sql$') then 'migration'
   when name like 'use%' and regexp_matches(name, '\\.(ts|tsx)$') then 'hook'
   when regexp_matches(path, '^(src/)?(redux/apis|services)/') then 'apiClient'
   when regexp_matches(name, '^[A-Z].*\\.(tsx|jsx)$') then 'component'
   else 'source' end as kind,
   is_test or list_has_any(segs, ['fixtures', '__fixtures__', 'testdata', 'test-data', 'evals', 'eval']) as is_test_data,
   regexp_matches(lower(path), '\\.(md|mdx|markdown|rst|txt|adoc)$') or list_has_any(segs, ['docs', 'doc', 'documentation']) as is_doc
 from base),
words as (select *, list_filter(regexp_split_to_array(lower(path), '[^a-z0-9]+'), lambda w: w <> '') as raw from kinds),
sing as (select *, list_concat(raw, list_transform(raw, lambda w: case when length(w) <= 3 or w like '%ss' then w when w like '%ies' then w[:-4] || 'y'
      when regexp_matches(w, '(s|x|z|ch|sh)es$') then w[:-3] when w like '%s' then w[:-2] else w end)) as seen from words),
flags as (select *, list_filter([
   case when kind in ('route', 'apiRoute', 'controller') then 'request surface' end,
   case when kind = 'apiClient' then 'frontend/backend contract' end,
   case when kind = 'schema' or list_has_any(seen, ['prisma', 'migration', 'schema']) or lower(path) like '%.sql%' then 'data model' end,
   case when list_has_any(seen, ['auth', 'session', 'jwt', 'permission', 'role', 'password', 'oauth', 'sso']) or list_contains(raw, 'token') then 'auth/security' end,
   case when list_has_any(seen, ['payment', 'billing', 'checkout', 'webhook', 'stripe', 'paystack', 'refund', 'invoice', 'subscription', 'chargeback', 'payout', 'fee', 'pricing', 'settlement']) then 'money flow' end,
   case when not is_test_data and (kind = 'config' or regexp_matches(lower(name), '^(dockerfile(\\.[^/]+)?|docker-compose(\\.[^/]+)?\\.ya?ml|tsconfig(\\.[^/]+)?\\.json|[^/]+\\.config\\.[cm]?[jt]sx?|\\.env(\\.[^/]+)?|\\.(nvmrc|node-version|tool-versions))$')
        or list_has_any(segs[1:len(segs)-1], ['config', 'configs', 'docker']) or list_has_any(seen, ['docker', 'tsconfig']) or lower(path) like '%.github/workflows%' or lower(path) like '%.circleci%') then 'configuration' end,
   case when not is_test_data and lower(name) in ('package.json', 'package-lock.json', 'yarn.lock', 'go.sum') then 'dependency' end,
   case when changed_lines >= 300 then 'large file diff' end], lambda f: f is not null) as flags from sing)
"""


def p1_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).select("id", P.kind(F.col("path")).alias("kind"))


P1_SQL = f"with {PATHS_CTE} select id, kind from kinds"


def p2_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return paths(spark, sf_dir).select(
        "id", P.is_test(p).alias("is_test"), P.is_runnable_test(p).alias("is_runnable_test"), P.is_doc(p).alias("is_doc"),
        P.is_markdown(p).alias("is_markdown"), P.is_skill(p).alias("is_skill"), P.is_fixture(p).alias("is_fixture"),
        P.is_test_data(p).alias("is_test_data"), P.is_secret(p).alias("is_secret"), P.is_git_hook(p).alias("is_git_hook"),
        P.is_vendor(p).alias("is_vendor"), P.is_gate_risk(p).alias("is_gate_risk"), P.is_template(p).alias("is_template"),
        P.is_prose(p, P.kind(p)).alias("is_prose"), P.is_doc_like(p).alias("is_doc_like"),
    )


P2_SQL = f"""with {PATHS_CTE}
select id, is_test, is_test and regexp_matches(path, '(?i)\\.(ts|tsx|js|jsx|mjs|cjs|mts|cts|go|cs|py|java|rb|rs)$') as is_runnable_test, is_doc,
  regexp_matches(name, '(?i)\\.(md|mdx|markdown)$') as is_markdown, kind = 'skill' or (regexp_matches(name, '(?i)\\.(md|mdx|markdown)$') and list_contains(segs[1:len(segs)-1], 'skills')) as is_skill,
  list_has_any(segs, ['fixtures', '__fixtures__', 'testdata', 'test-data']) as is_fixture, is_test_data,
  not is_doc and (regexp_matches(lower(name), '^(\\.env|\\.env\\.[^/]+|[^/]*\\.pem|[^/]*\\.key|id_rsa)$') or list_has_any(segs[1:len(segs)-1], ['secret', 'secrets', 'credentials'])) as is_secret,
  kind = 'gitHook' as is_git_hook,
  list_has_any(segs, ['node_modules', 'bower_components', 'vendor', 'third_party', 'third-party', 'dist', 'build']) as is_vendor,
  not is_test and not is_doc and not list_has_any(segs, ['fixtures', '__fixtures__', 'testdata', 'test-data'])
     and list_has_any(list_filter(flags, lambda f: f not in ('large file diff', 'request surface', 'frontend/backend contract', 'dependency')
         and not (f = 'data model' and kind = 'schema' and not list_has_any(seen, ['prisma', 'migration', 'schema']) and lower(path) not like '%.sql%')
         and not (f = 'configuration' and kind = 'config' and not list_has_any(segs[1:len(segs)-1], ['config', 'configs', 'docker']))),
        ['data model', 'auth/security', 'money flow', 'configuration']) as is_gate_risk,
  regexp_matches(lower(path), '\\.(example|sample|template|dist)$') as is_template, kind in ('doc', 'skill', 'changelog') as is_prose,
  regexp_matches(path, '(?i)(\\.(md|mdx|markdown|txt|rst|adoc)$|^docs?/)') as is_doc_like
from flags"""


def p3_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).select("id", P.domains(F.col("path")).alias("d")).select(
        "id", "d.primary", F.array_join("d.all", ",").alias("every")
    )


P3_SQL = f"""with {PATHS_CTE},
parts as (select id, string_split(regexp_replace(path, '^src/', ''), '/') as s, regexp_replace(path, '^src/', '') as p from paths),
named as (select id, len(s) as n, case when p like 'app/api/%' then s[3] when s[1] in ('app', 'pages') and s[2] is not null then s[2]
     when p like 'services/%' then regexp_replace(s[2], '-service\\.[jt]s$', '') else s[1] end as name,
   case when p like 'app/api/%' then case when len(s) > 4 then s[4] end when s[1] in ('app', 'pages') then case when len(s) > 3 then s[3] end
        when p like 'services/%' then null when s[1] in ('components', 'lib', 'utils', 'schemas', 'hooks', 'types') then case when len(s) > 2 then s[2] end end as extra from parts),
clean as (select id, regexp_replace(regexp_replace(regexp_replace(name, '\\.[cm]?[jt]sx?$', ''), '[()\\[\\]]', '', 'g'), '^\\.+$', 'root') as name,
   regexp_replace(regexp_replace(regexp_replace(extra, '\\.[cm]?[jt]sx?$', ''), '[()\\[\\]]', '', 'g'), '^\\.+$', 'root') as extra from named)
select id, case when name = '' then 'root' else name end as primary, case when extra is null or extra = name then name else extra || ',' || name end as every from clean"""


def p4_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).select("id", P.route(F.col("path")).alias("route"))


P4_SQL = f"""with {PATHS_CTE}
select id, case when regexp_matches(path, '^(src/)?(app|pages)/') and regexp_matches(name, '(page|layout|route)\\.[cm]?[jt]sx?$') then
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(path, '^(src/)?(app|pages)', ''), '/(page|layout|route)\\.[cm]?[jt]sx?$', ''), '\\([^/]+\\)/', '', 'g'), '\\[([^/]+)\\]', ':\\1', 'g') end as route
from base"""


def p5_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locales of part paths and of page URLs with their query removed."""
    pages = table(spark, sf_dir, "pages").select(
        (F.col("page_id") + 10_000_000).alias("id"), F.regexp_replace(F.regexp_replace("url", r"^https?://[^/]*/", ""), r"[?#].*$", "").alias("path")
    )
    rows = paths(spark, sf_dir).select("id", "path").unionByName(pages)
    return rows.select("id", P.locale(F.col("path")).alias("locale"), P.locale_catalog(F.col("path")).alias("catalog"))


LOCALE_TEST = (
    "(regexp_matches(x, '(?i)^(" + "|".join(LANGUAGE_CODES) + ")([-_][a-z]{4})?([-_]([a-z]{2}|[0-9]{3}))?$')"
    " or regexp_matches(x, '(?i)^[a-z]{3}([-_][a-z]{4}([-_]([a-z]{2}|[0-9]{3}))?|[-_]([a-z]{2}|[0-9]{3}))$'))"
)
P5_SQL = f"""with {PATHS_CTE},
every as (select id, path from paths union all
  select page_id + 10000000, regexp_replace(regexp_replace(url, '^https?://[^/]*/', ''), '[?#].*$', '') from pages),
parts as (select id, string_split(path, '/') as s, string_split(regexp_extract(path, '([^/]*)$', 1), '.') as n from every),
masked as (select id, list_concat(s[:len(s)-1], n[:len(n)-1]) as p, s[:len(s)-1] as s, n from parts)
select id, list_filter(p, lambda x: {LOCALE_TEST})[1] as locale,
  case when len(list_filter(p, lambda x: {LOCALE_TEST})) > 0 then array_to_string(list_concat(
    list_transform(s, lambda x: case when {LOCALE_TEST} then '*' else x end),
    [array_to_string(list_concat(list_transform(n[:len(n)-1], lambda x: case when {LOCALE_TEST} then '*' else x end), n[len(n):]), '.')]), '/') end as catalog
from masked"""


def p6_risk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return paths(spark, sf_dir).select(
        "id", F.array_join(F.array_sort(P.risk_flags(p, P.kind(p), F.col("changed_lines"))), "|").alias("flags")
    )


P6_SQL = f"with {PATHS_CTE} select id, coalesce(array_to_string(list_sort(flags), '|'), '') as flags from flags"


# ---------------------------------------------------------------- import graph
# File k of a repository of 500 parts imports files k/3, k/5 and k/7 of it, each in another style.
FILES_CTE = f"""
named as (select p_partkey as k, p_partkey // 500 as repo_id, {PATH_SQL} as path from part),
specs as (select f.k, f.repo_id, f.path,
   '@/' || regexp_replace(regexp_replace(a.path, '^src/', ''), '\\.tsx?$', '') as s1,
   repeat('../', length(regexp_replace(f.path, '[^/]', '', 'g'))) || regexp_replace(regexp_replace(b.path, '\\.ts$', '.js'), '/index\\.js$', '') as s2,
   regexp_replace(regexp_replace(c.path, '^src/', ''), '\\.[^./]+$', '') as s3
 from named f join named a on a.k = f.repo_id * 500 + (f.k - f.repo_id * 500) // 3
 join named b on b.k = f.repo_id * 500 + (f.k - f.repo_id * 500) // 5 join named c on c.k = f.repo_id * 500 + (f.k - f.repo_id * 500) // 7),
imports as (select distinct repo_id, path as src, unnest([s1, s2, s3]) as specifier from specs)
"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spread(table(spark, sf_dir, "part"))
    named = part.select(
        F.col("p_partkey").alias("k"), F.floor(F.col("p_partkey") / 500).alias("repo_id"), F.expr(PATH_SQL).alias("path")
    )
    base = F.col("repo_id") * 500

    def target(n: int, name: str) -> DataFrame:
        return named.select(F.col("k").alias(f"k{n}"), F.col("path").alias(name))

    rows = named
    for n, name in ((3, "a"), (5, "b"), (7, "c")):
        rows = rows.withColumn(f"k{n}", base + F.floor((F.col("k") - base) / n)).join(shuffled(target(n, name)), f"k{n}")
    depth = F.length(F.regexp_replace("path", "[^/]", ""))
    s1 = F.concat(F.lit("@/"), F.regexp_replace(F.regexp_replace("a", "^src/", ""), r"\.tsx?$", ""))
    s2 = F.concat(F.repeat(F.lit("../"), depth), F.regexp_replace(F.regexp_replace("b", r"\.ts$", ".js"), r"/index\.js$", ""))
    s3 = F.regexp_replace(F.regexp_replace("c", "^src/", ""), r"\.[^./]+$", "")
    p = F.col("path")
    return rows.select(
        "repo_id", "k", "path", P.kind(p).alias("kind"), P.is_vendor(p).alias("is_vendor"), F.array(s1, s2, s3).alias("imports"),
    )


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared package names: repository 1 declares one that a folder is also called."""
    return table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 500).alias("repo_id")).distinct().where("repo_id = 1").select(
        "repo_id", F.lit("services").alias("package")
    )


SUFFIX_ROWS = ", ".join(f"({i}, '{s}')" for i, s in enumerate(g.IMPORT_SUFFIXES))
RESOLVE_CTE = f"""{FILES_CTE},
suffixes(sr, suffix) as (values {SUFFIX_ROWS}),
keyed as (select *, case when specifier like '@/%' then [specifier[3:], 'src/' || specifier[3:]]
            when specifier like '.%' then [regexp_replace(specifier, '^(\\.\\./)+', '')] else [] end as bases from imports),
stems as (select repo_id, src, specifier, list_concat([], flatten(list_transform(bases, lambda b: case when regexp_matches(b, '\\.[cm]?js$')
     then [b, regexp_replace(b, '\\.([cm]?)js$', '.\\1ts'), regexp_replace(b, '\\.js$', '.tsx')] else [b] end))) as keys from keyed),
cand as (select repo_id, src, specifier, unnest(keys) as key, generate_subscripts(keys, 1) as kr from stems),
resolved as (select c.repo_id, c.src, c.specifier, arg_min(f.path, (kr, sr)) as dst
   from cand c, suffixes s join {{files}} f on true where f.repo_id = c.repo_id and f.path = c.key || s.suffix group by 1, 2, 3)
"""


def _resolve(files_name: str) -> str:
    return RESOLVE_CTE.replace("{files}", files_name)


def j3_resolve_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return g.resolve_imports(g.import_rows(f), f)


J3_SQL = f"with {_resolve('named')} select * from resolved"

SOURCES_CTE = f"""{PATHS_CTE},
{FILES_CTE.strip()},
sources as (select n.* from named n join kinds on kinds.id = n.k where kind <> 'doc'
   and not list_has_any(segs, ['node_modules', 'bower_components', 'vendor', 'third_party', 'third-party', 'dist', 'build']))
"""
EDGES_CTE = (
    SOURCES_CTE
    + ","
    + _resolve("sources").split(FILES_CTE)[1].lstrip(",\n").replace("from imports)", "from imports where (repo_id, src) in (select (repo_id, path) from sources))", 1)
    + """,
stem as (select repo_id, path, string_split(regexp_replace(regexp_replace(path, '\\.[^./]+$', ''), '/index$', ''), '/') as s from sources),
skeys as (select repo_id, path, unnest(list_transform(range(1, len(s)), lambda i: array_to_string(s[i:], '/'))) as key from stem),
unique_keys as (select repo_id, key, min(path) as dst from skeys group by 1, 2 having count(*) = 1),
open_specs as (select * from imports i where (repo_id, src) in (select (repo_id, path) from sources)
    and not exists (select 1 from resolved r where r.repo_id = i.repo_id and r.src = i.src and r.specifier = i.specifier)),
inferred as (select o.repo_id, o.src, o.specifier, u.dst from open_specs o join unique_keys u on u.repo_id = o.repo_id
    and u.key = regexp_replace(regexp_replace(o.specifier, '\\.[cm]?[jt]sx?$', ''), '/index$', '')
    where o.specifier not like '.%' and o.specifier not like '@/%' and o.specifier like '%/%' and not (o.repo_id = 1 and o.specifier like 'services/%')),
edges as (select repo_id, src, dst, case when min(r) = 0 then 'EXTRACTED' else 'INFERRED' end as provenance
   from (select repo_id, src, dst, 0 as r from resolved union all select repo_id, src, dst, 1 from inferred) where src <> dst group by 1, 2, 3)
"""
)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifiers and files meet several times: the files are joined with what they import once and written."""
    return g.build_edges(written(files(spark, sf_dir), "files"), packages(spark, sf_dir))


def j4_inferred_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).where("not is_vendor and kind <> 'doc'")
    imports = g.import_rows(f)
    open_specs = imports.join(g.resolve_imports(imports, f), ["repo_id", "src", "specifier"], "left_anti")
    return g.infer_imports(open_specs, f, packages(spark, sf_dir))


J4_SQL = f"with {EDGES_CTE} select * from inferred"


def j5_package_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    modules = f.select("repo_id").distinct().select(
        "repo_id",
        F.explode(F.array(
            F.struct(F.concat(F.lit("example.com/r"), F.col("repo_id").cast("string")).alias("module"), F.lit(".").alias("dir")),
            F.struct(F.concat(F.lit("example.com/r"), F.col("repo_id").cast("string"), F.lit("/svc")).alias("module"), F.lit("src/services").alias("dir")),
        )).alias("m"),
    ).select("repo_id", "m.*")
    p = F.col("path")
    folder = P.dirname(p)
    imports = f.select(
        "repo_id", p.alias("src"),
        F.concat(F.lit("example.com/r"), F.col("repo_id").cast("string"), F.lit("/"),
                 F.when(folder.startswith("src/services"), F.regexp_replace(folder, "^src/services", "svc")).otherwise(folder)).alias("specifier"),
    )
    return g.directory_edges(g.package_dirs(imports, modules, f), f)


J5_SQL = f"""with {FILES_CTE},
t as (select *, regexp_replace(path, '/[^/]*$', '') as dir,
   regexp_matches(path, '(^|/)(__tests__|test|tests|__snapshots__|snapshots)(/|$)|\\.(spec|test)\\.[jt]sx?$') as is_test from named),
targets as (select * from t where not is_test)
select a.repo_id, a.path as src, b.path as dst from t a join targets b on a.repo_id = b.repo_id and a.dir = b.dir"""


def j6_loose_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL ranks the files of a folder by path alone and takes five; the operator gives all, by kind."""
    f = files(spark, sf_dir)
    every = g.loose_candidates(g.import_rows(f), f)
    kind = F.when(F.col("specifier").startswith("."), 0).otherwise(F.col("kind"))
    order = Window.partitionBy("repo_id", "src", "specifier").orderBy(kind, "path")
    return every.select("repo_id", "src", "specifier", "path", F.row_number().over(order).alias("position")).where("position <= 5")


J6_SQL = f"""with {FILES_CTE},
rel as (select repo_id, src, specifier, regexp_replace(regexp_replace(specifier, '^(\\.\\./)+', ''), '/[^/]+$', '') as folder from imports where specifier like '.%'),
bare as (select repo_id, src, specifier, regexp_extract(specifier, '([^/]+)$', 1) as tail from imports where specifier not like '.%'),
nm as (select repo_id, path, regexp_extract(path, '([^/]+)$', 1) as base from named),
every as (select r.repo_id, r.src, r.specifier, f.path, 0 as kind from rel r join named f on f.repo_id = r.repo_id and starts_with(f.path, r.folder || '/')
  union all select b.repo_id, b.src, b.specifier, f.path, case when f.base = b.tail then 0 else 1 end from bare b join nm f on f.repo_id = b.repo_id
     and (f.base = b.tail or regexp_replace(f.base, '\\.[^.]+$', '') = regexp_replace(b.tail, '\\.[^.]+$', ''))),
hits as (select repo_id, src, specifier, path, min(kind) as kind from every group by all)
select * exclude (kind) from (select *, row_number() over (partition by repo_id, src, specifier order by kind, path) as position from hits) where position <= 5"""


def j6_exact_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file that a specifier names by path, stem, index or last segment, without those merely in its folder."""
    f = files(spark, sf_dir)
    return g.loose_candidates(g.import_rows(f), f, folders=False)


J6X_SQL = f"""with {FILES_CTE},
rel as (select repo_id, src, specifier, regexp_replace(specifier, '^(\\.\\./)+', '') as j from imports where specifier like '.%'),
bare as (select repo_id, src, specifier, regexp_extract(specifier, '([^/]+)$', 1) as tail from imports where specifier not like '.%'),
nm as (select repo_id, path, regexp_extract(path, '([^/]+)$', 1) as base, regexp_replace(path, '\\.[^./]+$', '') as stem from named),
every as (select r.repo_id, r.src, r.specifier, f.path, case when f.path = r.j then 0 when f.stem = r.j then 1 else 2 end as kind from rel r join nm f on f.repo_id = r.repo_id and (f.path = r.j or f.stem = r.j or f.stem = r.j || '/index')
  union all select b.repo_id, b.src, b.specifier, f.path, case when f.base = b.tail then 0 else 1 end from bare b join nm f on f.repo_id = b.repo_id
     and (f.base = b.tail or regexp_replace(f.base, '\\.[^.]+$', '') = regexp_replace(b.tail, '\\.[^.]+$', ''))),
hits as (select repo_id, src, specifier, path, min(kind) as kind from every group by all)
select *, row_number() over (partition by repo_id, src, specifier order by kind, path) as position from hits"""


def g2_build_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir)


G2_SQL = f"with {EDGES_CTE} select * from edges"


def g2_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.edge_counts(edges(spark, sf_dir))


G2C_SQL = f"with {EDGES_CTE} select repo_id, count(*) as edges, count(*) filter (provenance = 'INFERRED') as inferred_edges from edges group by 1"


def g3_specific_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.specific_edges(edges(spark, sf_dir), 2)


G3_SQL = f"with {EDGES_CTE} select * from edges e where (select count(*) from edges x where x.repo_id = e.repo_id and x.dst = e.dst) <= 2"


def a24_import_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.import_degrees(files(spark, sf_dir))


A24_SQL = f"""with {PATHS_CTE}, {_resolve('named').strip()},
who as (select n.repo_id, n.path from named n join kinds on kinds.id = n.k where kind <> 'test'
   and not list_has_any(segs, ['node_modules', 'bower_components', 'vendor', 'third_party', 'third-party', 'dist', 'build'])),
e as (select distinct repo_id, src, dst from resolved where src <> dst and (repo_id, src) in (select (repo_id, path) from who)),
ends as (select repo_id, dst as path, 1 as i, 0 as o from e union all select repo_id, src, 0, 1 from e)
select repo_id, path, cast(sum(i) as bigint) as importers, cast(sum(o) as bigint) as imports from ends group by 1, 2"""


def g1_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    starts = f.where("k % 500 between 1 and 9").select("repo_id", (F.col("k") % 3).alias("start_set"), "path")
    out = g.dependents(edges(spark, sf_dir), starts, 3, 20)
    return out.select("repo_id", "start_set", "path", "depth", "provenance", "via", "position", "truncated")


G1_SQL = f"""with {EDGES_CTE},
l0 as (select repo_id, k % 3 as s, path, 0 as r from named where k % 500 between 1 and 9),
l1 as (select l0.repo_id, s, e.src as path, min(row(case when e.provenance = 'EXTRACTED' then 0 else 1 end, e.dst)) as b from l0 join edges e on e.repo_id = l0.repo_id and e.dst = l0.path
   where (l0.repo_id, s, e.src) not in (select (repo_id, s, path) from l0) group by 1, 2, 3),
l2 as (select l1.repo_id, s, e.src as path, min(row(greatest(l1.b[1], case when e.provenance = 'EXTRACTED' then 0 else 1 end), e.dst)) as b from l1 join edges e on e.repo_id = l1.repo_id and e.dst = l1.path
   where (l1.repo_id, s, e.src) not in (select (repo_id, s, path) from l0 union all select (repo_id, s, path) from l1) group by 1, 2, 3),
l3 as (select l2.repo_id, s, e.src as path, min(row(greatest(l2.b[1], case when e.provenance = 'EXTRACTED' then 0 else 1 end), e.dst)) as b from l2 join edges e on e.repo_id = l2.repo_id and e.dst = l2.path
   where (l2.repo_id, s, e.src) not in (select (repo_id, s, path) from l0 union all select (repo_id, s, path) from l1 union all select (repo_id, s, path) from l2) group by 1, 2, 3),
a as (select repo_id, s, path, 1 as depth, b from l1 union all select repo_id, s, path, 2, b from l2 union all select repo_id, s, path, 3, b from l3),
o as (select repo_id, s as start_set, path, depth, case when b[1] = 0 then 'EXTRACTED' else 'INFERRED' end as provenance, b[2] as via,
   row_number() over (partition by repo_id, s order by depth, b[1], path) as position, count(*) over (partition by repo_id, s) > 20 as truncated from a)
select * from o where position <= 20"""


QUERIES = {
    "p1_kind": (p1_kind, P1_SQL),
    "p2_predicates": (p2_predicates, P2_SQL),
    "p3_domain": (p3_domain, P3_SQL),
    "p4_route": (p4_route, P4_SQL),
    "p5_locale": (p5_locale, P5_SQL),
    "p6_risk_flags": (p6_risk_flags, P6_SQL),
    "j3_resolve_imports": (j3_resolve_imports, J3_SQL),
    "j4_inferred_edges": (j4_inferred_edges, J4_SQL),
    "j5_package_edges": (j5_package_edges, J5_SQL),
    "j6_loose_candidates": (j6_loose_candidates, J6_SQL),
    "j6_exact_candidates": (j6_exact_candidates, J6X_SQL),
    "g2_build_edges": (g2_build_edges, G2_SQL),
    "g2_edge_counts": (g2_edge_counts, G2C_SQL),
    "g3_specific_edges": (g3_specific_edges, G3_SQL),
    "a24_import_degrees": (a24_import_degrees, A24_SQL),
    "g1_dependents": (g1_dependents, G1_SQL),
}
