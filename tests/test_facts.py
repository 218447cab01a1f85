"""Facts of source text on literal files, above all those that depend on earlier lines."""

import pytest

from tallywake.sources import corpus as sc


def facts(spark, path, text, *types):
    files = spark.createDataFrame([("r", path, text)], "repo_id string, path string, text string")
    return sorted((f.type, f.name, f.line) for f in sc.source_facts(files).collect() if f.type in types)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("export { a, b as c };", [("name", "a", 1), ("name", "b", 1)]),
        ("export {\n  a,\n  b as c,\n}", [("name", "a", 2), ("name", "b", 3)]),
        ("const q = {};\nexport { a,\nb,\n c } from './x'; export { d,\n e }", [("name", "a", 2), ("name", "b", 3), ("name", "c", 4), ("name", "d", 4), ("name", "e", 5)]),
        ("export {\n // a note\n a\n}\nfunction f() {\n  b,\n}", [("name", "a", 3)]),
        ("export\t{\n a\n b as\n}", [("name", "a", 2), ("name", "b as", 3)]),
        ("}\nexport { never", []),
        ("export { a\n}\nexport {\n never,\n closed\n", [("name", "a", 1)]),
        ("x {\n a,\n}", []),
    ],
)
def test_export_lists_over_lines(spark, text, want):
    assert facts(spark, "a.ts", text, "name") == want


def test_a_list_longer_than_a_slice(spark, monkeypatch):
    monkeypatch.setattr(sc, "SLICE_LINES", 3)
    names = [f"n{i:02}" for i in range(20)]
    text = "export {\n" + ",\n".join(names) + "\n};\nlet = {\n x,\n};"
    assert facts(spark, "a.js", text, "name") == [("name", n, i + 2) for i, n in enumerate(names)]


def test_front_matter(spark):
    text = "---\nname: the-skill\ndescription: >-\n  folded prose: here\n# a comment\nlong: " + "x" * 81 + "\nempty:\n---\n# Heading ##\nkey: value\n"
    got = facts(spark, "SKILL.md", text, "frontmatter", "heading")
    assert got == [("frontmatter", "description", 3), ("frontmatter", "empty", 7), ("frontmatter", "long", 6), ("frontmatter", "name", 2), ("frontmatter", "the-skill", 2), ("heading", "Heading", 9)]
    assert facts(spark, "a.md", "---\nname: x\n", "frontmatter") == []  # never closed
    assert facts(spark, "a.md", "\n---\nname: x\n---\n", "frontmatter") == []
    assert facts(spark, "a.ts", text, "frontmatter") == []


def test_artefacts(spark):
    assert facts(spark, "m.sql", "UPDATE users SET \"status\" = 1;\nalter table t add column if not exists c int;", "table", "column") == [("column", "c", 2), ("column", "status", 1), ("table", "t", 2), ("table", "users", 1)]
    assert facts(spark, "v.hbs", "{{> header}} {{ >footer }}\n{{#if ready}}{{title}}", "partial", "template") == [("partial", "footer", 1), ("partial", "header", 1), ("template", "footer", 1), ("template", "header", 1), ("template", "if", 2), ("template", "title", 2)]
    assert facts(spark, "s.prisma", "enum Role {\n  ADMIN\n}\nmodel User {\n  id Int\n}", "enum", "model", "field") == [("enum", "Role", 1), ("field", "id", 5), ("model", "User", 4)]
