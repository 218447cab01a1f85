"""Owner rules and approvals (S15 parsing, J13, J14, A36)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywake.functions import paths as P
from tallywake.functions.text import let, lit_array
from tallywake.session import shuffled

LOCATIONS = [".github/CODEOWNERS", "CODEOWNERS", "docs/CODEOWNERS"]


def parse_rules(files: DataFrame) -> DataFrame:
    """rules(repo_id, rule_no, pattern, owners) from files(repo_id, path, text).

    The first location that exists in a repository is used; an unescaped '#'
    starts a comment; a rule needs at least one owner; order is kept.
    """
    place = F.array_position(lit_array(LOCATIONS), F.col("path"))
    chosen = files.where(place > 0).groupBy("repo_id").agg(F.min_by("text", place).alias("text"))
    lines = chosen.select("repo_id", F.posexplode(F.split("text", r"\r?\n")).alias("rule_no", "raw"))
    body = F.trim(F.regexp_replace(F.regexp_replace("raw", r"(?<!\\)#.*$", ""), r"\s+", " "))
    parts = F.split(body, " ")
    return lines.where((body != "") & (F.size(parts) >= 2)).select(
        "repo_id", "rule_no", F.regexp_replace(parts[0], r"\\#", "#").alias("pattern"), F.slice(parts, 2, F.size(parts)).alias("owners")
    )


def pattern_regex(pattern: Column) -> Column:
    """One anchored regular expression per owner pattern."""
    slashed = F.translate(F.trim(pattern), "\\", "/")
    only_dir = slashed.endswith("/")
    body = F.regexp_replace(slashed, r"^/|/$", "")
    anchored = slashed.startswith("/")
    full = F.when(only_dir, F.concat(body, F.lit("/**"))).otherwise(body)
    escaped = F.regexp_replace(full, r"([\\^$.+()\[\]{}|])", r"\\$1")
    glob = F.regexp_replace(escaped, r"\*\*", "\u0001")
    glob = F.regexp_replace(glob, r"\*", "[^/]*")
    glob = F.regexp_replace(glob, r"\?", "[^/]")
    glob = F.regexp_replace(glob, "\u0001", ".*")
    at_root = anchored & full.contains("/")
    return F.when(at_root, F.concat(F.lit("^"), glob, F.lit("$"))).otherwise(F.concat(F.lit("(^|.*/)"), glob, F.lit("$")))


def match_owners(files: DataFrame, rules: DataFrame) -> DataFrame:
    """files(..., repo_id, path) with the owners and number of the last rule that matches.

    A plain rule is posted under one key: the folder it covers, the path it is, or
    the ending it asks for. A path looks its own folders and endings up, so what it
    costs does not grow with the plain rules. Only rules with other wildcards are
    tested one by one, as one array per repository, last first.
    """
    tested = rules.withColumn("test", let(F.col("pattern"), _rule_test))
    named, clean = files.select("repo_id", "path").distinct(), P.normalize(P.forward(F.col("path")))
    posted = tested.where("test.mode <> 'regex'").groupBy("repo_id", F.col("test.mode").alias("mode"), F.col("test.text").alias("text")).agg(F.max_by(F.struct("rule_no", "owners"), "rule_no").alias("hit"))
    looked_up = named.select("repo_id", "path", F.explode(let(clean, _path_keys)).alias("k")).select("repo_id", "path", "k.mode", "k.text")
    plain = looked_up.join(shuffled(posted), ["repo_id", "mode", "text"]).select("repo_id", "path", "hit")

    wild = tested.where("test.mode = 'regex'").groupBy("repo_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("rule_no", F.col("test.text").alias("text"), "owners")))).alias("_rules"))
    none = F.lit(None).cast("struct<rule_no:int,text:string,owners:array<string>>")
    first = F.aggregate("_rules", none, lambda found, r: F.when(found.isNotNull(), found).when(F.regexp_like(F.col("_clean"), r["text"]), r))
    by_pattern = named.withColumn("_clean", clean).join(shuffled(wild), "repo_id").withColumn("_f", first).where("_f is not null").select("repo_id", "path", F.struct("_f.rule_no", "_f.owners").alias("hit"))

    last = plain.unionByName(by_pattern).groupBy("repo_id", "path").agg(F.max_by("hit", "hit.rule_no").alias("_hit"))
    return files.join(shuffled(last), ["repo_id", "path"], "left").select(
        *files.columns, F.coalesce(F.col("_hit.owners"), F.array().cast("array<string>")).alias("owners"), F.col("_hit.rule_no").alias("rule_no")
    )


def _path_keys(path: Column) -> Column:
    """Every key under which a plain rule for a path may be posted: (mode, text) as ``_rule_test`` makes them."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    n = F.size(folders)
    key = lambda mode, text: F.struct(F.lit(mode).alias("mode"), text.alias("text"))
    empty = F.array().cast("array<struct<mode:string,text:string>>")

    def joined(start: Column, count: Column) -> Column:
        return F.concat(F.lit("/"), F.array_join(F.slice(folders, start, count), "/"), F.lit("/"))

    counts = F.sequence(F.lit(1), n)
    leading = F.when(n > 0, F.transform(counts, lambda i: key("from", joined(F.lit(1), i)))).otherwise(empty)
    # Every run of folders, by where it starts and how long it is.
    inner = F.when(n > 0, F.flatten(F.transform(counts, lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: key("under", joined(i, k)))))).otherwise(empty)
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: key("end", F.concat(F.lit("/"), F.array_join(F.slice(parts, i, F.size(parts)), "/"))))
    dotted = F.split(F.element_at(parts, -1), r"\.")
    endings = F.when(
        F.size(dotted) > 1, F.transform(F.sequence(F.lit(2), F.size(dotted)), lambda i: key("end", F.concat(F.lit("."), F.array_join(F.slice(dotted, i, F.size(dotted)), "."))))
    ).otherwise(empty)
    return F.array_distinct(F.concat(F.array(key("is", F.concat(F.lit("/"), path))), leading, inner, tails, endings))


def _rule_test(pattern: Column) -> Column:
    """What a pattern asks of '/path': a key where it holds no wildcard or begins with ``*.``, else its expression."""
    slashed = F.translate(F.trim(pattern), "\\", "/")
    body = F.regexp_replace(slashed, r"^/|/$", "")
    folder = F.regexp_replace(body, r"/\*\*$", "")
    into = slashed.endswith("/") | body.endswith("/**")
    anchored = slashed.startswith("/") & (body.contains("/") | slashed.endswith("/"))
    plain = ~folder.rlike(r"[*?]")
    suffix = body.rlike(r"^\*\.[^*?/]+$") & ~into
    test = lambda mode, text: F.struct(F.lit(mode).alias("mode"), text.alias("text"))
    return (
        F.when(plain & into & anchored, test("from", F.concat(F.lit("/"), folder, F.lit("/"))))
        .when(plain & into, test("under", F.concat(F.lit("/"), folder, F.lit("/"))))
        .when(plain & anchored, test("is", F.concat(F.lit("/"), body)))
        .when(plain, test("end", F.concat(F.lit("/"), body)))
        .when(suffix, test("end", F.substring(body, 2, 1 << 20)))
        .otherwise(test("regex", pattern_regex(pattern)))
    )


def approvals(reviews: DataFrame) -> DataFrame:
    """Logins whose last deciding review approved. reviews(change_id, seq, login, state)."""
    login, state = F.lower(F.trim("login")), F.upper(F.trim("state"))
    deciding = reviews.where((login != "") & state.isin("APPROVED", "CHANGES_REQUESTED", "DISMISSED"))
    last = deciding.groupBy("change_id", login.alias("login")).agg(F.max_by(state, F.struct(F.col("seq"), state)).alias("state"))
    return last.where("state = 'APPROVED'").select("change_id", "login")


def approval_status(owned: DataFrame, approved: DataFrame, members: DataFrame) -> DataFrame:
    """(change_id, path, status) for owned files: approved, manual or missing.

    owned(change_id, path, owners), approved(change_id, login),
    members(org, slug, login) are active team members.
    """
    each = owned.where(F.size("owners") > 0).select("change_id", "path", F.explode("owners").alias("raw")).withColumn("owner", F.trim("raw"))
    is_user = F.col("owner").startswith("@") & ~F.col("owner").contains("/")
    team = F.regexp_extract("owner", r"^@([^/]+)/(.+)$", 1)
    slug = F.regexp_extract("owner", r"^@([^/]+)/(.+)$", 2)
    marked = each.withColumns({
        "login": F.when(is_user, F.lower(F.regexp_replace("owner", "^@", ""))), "org": F.when(team != "", team), "slug": F.when(team != "", slug),
        "external": (F.col("owner") != "") & ~F.col("owner").startswith("@"),
    })
    teams_ok = members.select("org", "slug", F.lower("login").alias("login")).join(approved, "login").select("change_id", "org", "slug").distinct().withColumn("team_ok", F.lit(True))
    yes = approved.withColumn("user_ok", F.lit(True))
    joined = marked.join(shuffled(yes), ["change_id", "login"], "left").join(shuffled(teams_ok), ["change_id", "org", "slug"], "left")
    facts = joined.groupBy("change_id", "path").agg(
        F.bool_or(F.coalesce("user_ok", "team_ok", F.lit(False))).alias("ok"),
        F.bool_or("external").alias("external"),
        F.bool_or(F.col("org").isNotNull()).alias("has_team"),
        F.bool_or(F.col("external") | F.col("owner").contains("/")).alias("team_or_external"),
    )
    status = (
        F.when(F.col("ok"), "approved").when(F.col("external"), "manual").when(F.col("has_team"), "missing")
        .when(F.col("team_or_external"), "manual").otherwise("missing")
    )
    return facts.select("change_id", "path", status.alias("status"))
