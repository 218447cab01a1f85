"""Licence notices in documents: min-hash bands over text windows retrieve templates, exact containment confirms them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Wording of well-known licences and of notices that name one.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-licensed": "This project is licensed under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        'required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" '
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
}

#: Words of a shingle, and the share of a template's that must be there.
SHINGLE, CONTAINED = 5, 0.8
#: Bands of one min-hash each.
BANDS = 64


def plain_words(text: Column) -> Column:
    """ASCII letters and digits in lower case, everything else one space."""
    return F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+", " ")))


def _key(words: Column, start: Column) -> Column:
    """A hash of the shingle of ``words`` that begins at ``start``."""
    return F.xxhash64(*[F.get(words, start + k) for k in range(SHINGLE)])


def _banded(key: Column, band: Column) -> Column:
    """The hash of a shingle in a band; every band has its own."""
    return F.xxhash64(key, band)


def signatures(spark: SparkSession, templates: dict[str, str]) -> list[dict]:
    """license, shingles, length (shingles of a window) and bands of each template.

    A band is its number and the key of the shingle that is the template's minimum
    there. What reaches the driver is bounded by the templates.
    """
    given = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in templates.items()])
    words = spark.range(1).select(F.inline(given)).select("license", F.split(plain_words(F.col("text")), " ").alias("words")).where(F.size("words") >= SHINGLE)
    starts = F.sequence(F.lit(0), F.size("words") - SHINGLE)
    shingles = F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice("words", i + 1, SHINGLE), " ")))
    keys = F.transform(starts, lambda i: _key(F.col("words"), i))
    places = words.select("license", (F.size("words") - SHINGLE + 1).alias("length"), shingles.alias("shingles"), F.explode(keys).alias("key"))
    banded = places.select("*", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    least = banded.groupBy("license", "length", "shingles", "band").agg(F.min_by("key", F.struct(_banded(F.col("key"), F.col("band")), "key")).alias("key"))
    whole = least.groupBy("license", "length", "shingles").agg(F.array_sort(F.collect_list(F.struct("key", "band"))).alias("bands"))
    return [row.asDict(recursive=True) for row in whole.orderBy("license").collect()]


_TEMPLATE = "array<struct<license: string, length: int, shingles: array<string>, bands: array<struct<key: bigint, band: int>>>>"


def _hits(words: Column, given: list[dict]) -> Column:
    """Place and key of every shingle of ``words`` that is the least of a template in some band."""
    keys = sorted({b["key"] for t in given for b in t["bands"]})
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - SHINGLE, F.lit(0))), lambda i: _key(words, i).isin(keys))
    return F.transform(places, lambda i: F.struct(i.alias("place"), _key(words, i).alias("key")))


def _retrieved(words: Column, hits: Column, given: list[dict]) -> Column:
    """The templates that share a band with a window of ``words``; a window has as many shingles as the template.

    Windows lie at every word. A window shares a band with a template only if its
    least shingle there is the template's, so only windows around such a shingle
    are looked at: there is one if enough shingles on both sides have greater hashes.
    """
    count = F.size(words) - SHINGLE + 1

    def shares(hit: Column, band: Column, length: Column) -> Column:
        place, own = hit["place"], _banded(hit["key"], band)
        first, last = F.greatest(place - length + 1, F.lit(0)), F.least(place + length - 1, count - 1)
        lower = F.filter(F.sequence(first, last), lambda i: _banded(_key(words, i), band) < own)
        before = F.coalesce(F.array_max(F.filter(lower, lambda i: i < place)), first - 1)
        after = F.coalesce(F.array_min(F.filter(lower, lambda i: i > place)), last + 1)
        return after - before - 1 >= F.least(length, count)

    table = F.from_json(F.lit(json.dumps(given)), _TEMPLATE)
    return F.filter(table, lambda t: F.exists(hits, lambda h: F.exists(t["bands"], lambda b: (b["key"] == h["key"]) & shares(h, b["band"], t["length"]))))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, contained: float = CONTAINED) -> DataFrame:
    """Templates that stand in a document, word for word or nearly so.

    Every window of a text with a template's length has 64 min-hashes, each a band
    of its own with its own hash; one band in common retrieves the template. A
    window with the template's shingles shares every band. At containment 0.8 in
    one window (similarity 2/3) all bands differ with probability (1/3)^64; if every
    such shingle lies alone among foreign ones, a band still agrees with
    probability 0.4, and all 64 differ with about 6e-15.
    The match counts if the document holds at least ``contained`` of the
    template's distinct five-word shingles. Only DataFrame functions are used, and
    no row leaves its place: there is no shuffle.

    Returns doc_id, license, n_shingles, n_found and containment, one row per row
    of ``docs`` and matching template: repeated rows match as often as they
    stand. Null, empty and very short texts match nothing; a null doc_id stays
    null; templates under five words are left out. An empty table gives no row.
    Other columns are not looked at. Templates are a short list: they and their
    bands are constants of the plan.
    """
    given = signatures(docs.sparkSession, TEMPLATES if templates is None else templates)
    plain = docs.select("doc_id", plain_words(F.col("text")).alias("plain"))
    # A generator of one row keeps the optimiser from putting the whole expression wherever its column is used.
    cut = plain.select("doc_id", "plain", F.explode(F.array(F.split("plain", " "))).alias("words"))
    hit = cut.select("doc_id", "plain", "words", F.explode(F.array(_hits(F.col("words"), given))).alias("hits")).where(F.size("hits") > 0)
    found = hit.select("doc_id", F.concat(F.lit(" "), "plain", F.lit(" ")).alias("held"), F.explode(_retrieved(F.col("words"), F.col("hits"), given)).alias("t"))
    matched = found.select(
        "doc_id",
        F.col("t.license").alias("license"),
        F.size("t.shingles").cast("long").alias("n_shingles"),
        F.size(F.filter("t.shingles", lambda s: F.contains("held", F.concat(F.lit(" "), s, F.lit(" "))))).cast("long").alias("n_found"),
    )
    return matched.withColumn("containment", F.col("n_found") / F.col("n_shingles")).where(F.col("n_found") >= contained * F.col("n_shingles"))


def oracle(templates: dict[str, str] | None = None, contained: float = CONTAINED) -> str:
    """DuckDB SQL for the same rows: every template's shingles looked for in every text."""
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in (TEMPLATES if templates is None else templates).items())
    plain = "trim(lower(regexp_replace(coalesce({}, ''), '[^A-Za-z0-9]+', ' ', 'g')))"
    return f"""
with t as (select license, string_split({plain.format("text")}, ' ') as w from (values {rows}) v(license, text)),
s as (select distinct license, array_to_string(w[i:i + {SHINGLE - 1}], ' ') as shingle from t, unnest(range(1, len(w) - {SHINGLE - 2})) u(i) where len(w) >= {SHINGLE}),
n as (select license, count(*) as n_shingles from s group by license),
d as (select row_number() over () as r, doc_id, ' ' || {plain.format("text")} || ' ' as held from documents),
f as (select d.r, d.doc_id, s.license, count(*) as n_found from d join s on contains(d.held, ' ' || s.shingle || ' ') group by all)
select doc_id, license, n_shingles, n_found, n_found / n_shingles as containment
from f join n using (license) where n_found >= {contained} * n_shingles"""
