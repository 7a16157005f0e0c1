"""Licences by sentences: normalised sentences become identifiers, and rules match runs of identifiers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Identifier and pattern of a whole normalised sentence (lower case, single blanks, no mark at the ends). First match wins.
GIVEN = "((this|the) (work|program|software|file|project|library|document|code) is )?(licensed|released|distributed|available|published)"
FREE = ("this (program|software|file|library|work) is free software[:;,]? you can redistribute it and/or modify it "
        "under the terms of (version [0-9.]+ of )?the")
FSF = "as published by the free software foundation[;,:]? (either )?version"
LATER = " of the license,? or,? .?at your option.?,? any later version"
SENTENCES = (
    ("spdx_mit", "spdx-license-identifier: mit"),
    ("spdx_apache2", "spdx-license-identifier: apache-2.0"),
    ("spdx_bsd", "spdx-license-identifier: bsd-[23]-clause"),
    ("spdx_gpl3", "spdx-license-identifier: gpl-3.0(-only|-or-later)?"),
    ("spdx_gpl2", "spdx-license-identifier: gpl-2.0(-only|-or-later)?"),
    ("gpl3_later", f"{FREE} gnu general public license {FSF} 3{LATER}"),
    ("gpl2_later", f"{FREE} gnu general public license {FSF} 2{LATER}"),
    ("lgpl_later", f"{FREE} gnu (lesser|library) general public license {FSF} [23](.[01])?{LATER}"),
    ("agpl3_later", f"{FREE} gnu affero general public license {FSF} 3{LATER}"),
    ("apache2", f"{GIVEN} under the apache license,? version 2.0( \\(the .license.\\))?(; you may not use this file except in compliance with the license)?"),
    ("mit", f"{GIVEN} under the mit license"),
    ("bsd", f"{GIVEN} under the (2-clause |3-clause )?bsd license"),
    ("lgpl", f"{GIVEN} under the (gnu )?lesser general public license,? version [23](.[01])?"),
    ("agpl3", f"{GIVEN} under the (gnu )?affero general public license,? version 3"),
    ("gpl3", f"{GIVEN} under the (gnu )?general public license,? version 3"),
    ("gpl2", f"{GIVEN} under the (gnu )?general public license,? version 2"),
    ("cc_nc", f"{GIVEN} under cc by-nc(-sa|-nd)? [0-9].0"),
    ("cc_by_sa", f"{GIVEN} under cc by-sa [0-9].0"),
    ("cc_by", f"{GIVEN} under cc by [0-9].0"),
    ("cc0", "(cc0( 1.0)?( universal)?|this work is dedicated to the public domain)"),
    ("later", "(either version [23] of the license, )?or (at your option|\\(at your option\\)) any later version"),
    ("apache_use", "you may not use this file except in compliance with the license"),
    ("apache_copy", "you may obtain a copy of the license at( .*)?"),
    ("mit_grant", "permission is hereby granted, free of charge, to any person obtaining a copy .*"),
    ("mit_notice", "the above copyright notice and this permission notice shall be included .*"),
    ("bsd_redist", "redistribution and use in source and binary forms, .*"),
    ("bsd_source", "([0-9]. |- )?redistributions of source code must retain .*"),
    ("bsd_binary", "([0-9]. |- )?redistributions in binary form must reproduce .*"),
    ("bsd_endorse", "([0-9]. |- )?neither the name of .* may be used to endorse .*"),
    ("as_is", "(the|this) software is provided (by .* )?.?as is.?,? .*"),
    ("all_rights", "(copyright .*)?all rights reserved"),
    ("copyright", "copyright .*"),
)

# Licence, kind and the run of identifiers that stands for it, most specific first; a run is used up by its first rule.
RULES = (
    ("MIT", "permissive", ("mit_grant", "mit_notice", "as_is")),
    ("MIT", "permissive", ("mit_grant", "mit_notice")),
    ("BSD-3-Clause", "permissive", ("bsd_redist", "bsd_source", "bsd_binary", "bsd_endorse", "as_is")),
    ("BSD-3-Clause", "permissive", ("bsd_redist", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", "permissive", ("bsd_redist", "bsd_source", "bsd_binary", "as_is")),
    ("BSD-2-Clause", "permissive", ("bsd_redist", "bsd_source", "bsd_binary")),
    ("Apache-2.0", "permissive", ("apache2", "apache_use", "apache_copy")),
    ("Apache-2.0", "permissive", ("apache2", "apache_copy")),
    ("GPL-3.0-or-later", "copyleft", ("gpl3_later",)),
    ("GPL-2.0-or-later", "copyleft", ("gpl2_later",)),
    ("LGPL", "copyleft", ("lgpl_later",)),
    ("AGPL-3.0-or-later", "copyleft", ("agpl3_later",)),
    ("GPL-3.0-or-later", "copyleft", ("gpl3", "later")),
    ("GPL-2.0-or-later", "copyleft", ("gpl2", "later")),
    ("Apache-2.0", "permissive", ("apache2",)),
    ("Apache-2.0", "permissive", ("spdx_apache2",)),
    ("MIT", "permissive", ("mit",)),
    ("MIT", "permissive", ("spdx_mit",)),
    ("BSD", "permissive", ("bsd",)),
    ("BSD", "permissive", ("spdx_bsd",)),
    ("LGPL", "copyleft", ("lgpl",)),
    ("AGPL-3.0", "copyleft", ("agpl3",)),
    ("GPL-3.0", "copyleft", ("gpl3",)),
    ("GPL-3.0", "copyleft", ("spdx_gpl3",)),
    ("GPL-2.0", "copyleft", ("gpl2",)),
    ("GPL-2.0", "copyleft", ("spdx_gpl2",)),
    ("CC-BY-NC", "restricted", ("cc_nc",)),
    ("CC-BY-SA", "copyleft", ("cc_by_sa",)),
    ("CC-BY", "permissive", ("cc_by",)),
    ("CC0-1.0", "permissive", ("cc0",)),
    ("Proprietary", "restricted", ("copyright", "all_rights")),
    ("Proprietary", "restricted", ("all_rights",)),
)
#: Every known sentence has one of these words; texts and sentences without one have no identifier.
KNOWN = "(?i)licen[sc]e|copyright|reserved|permission|redistribution|software|cc0|cc by|under[ \t\r\n]+cc|cc[ \t\r\n]+by|domain|later|neither"

# How texts fall into sentences: marks of comments at both ends of lines go, blank lines and ``.!?`` before a blank or line end
# part sentences. A sentence keeps its line ends.
MARK = "\x02"
STEPS = (
    ("[ \t\r]*([*]+/|-->)?[ \t\r]*(\n|$)", "\n"),
    ("(^|\n)[ \t]*(/[*]+|[*]+|//+|#+|--+|;+|%+|<!--)?[ \t]*", "\n"),
    ("\n\n+", MARK),
    ("([.!?])[ \t\r\n]+", "{0}" + MARK),
)
TRIM = (("[ \t\r\n]+", " "), ("^[ #*/;.!-]+|[ #*/;.!?:]+$", ""))


def _case(sentence: str, matches: str) -> str:
    whens = " ".join(f"WHEN {matches.format(sentence, f'^({pattern})$')} THEN '{name}'" for name, pattern in SENTENCES)
    return f"CASE {whens} END"


def licences(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_sentences, sentence_ids, licences, kinds, unmatched)`` for each row of ``docs (doc_id, text)``.

    Marks of comments at the ends of lines go. Sentences end at blank lines and at ``.!?`` before a blank or line end, and
    may go over several lines; of one that isn't known as a whole each line counts alone. Case, repeated blanks and marks
    at the ends don't count. ``sentence_ids`` are the known ones in order as ``<id>``; ``licences`` and ``kinds`` name,
    sorted and joined by commas, the rules whose run of identifiers occurs, where each rule uses up its runs before the
    next is tried; ``unmatched`` are identifiers no rule used. NULL and empty texts have none (empty strings); repeated
    rows are judged alike; other columns are ignored. One projection of built-in functions, no shuffle.
    """
    def quoted(x: str) -> str:
        return "'" + "".join(f"\\u{ord(c):04x}" if ord(c) < 32 else "\\\\" if c == "\\" else c for c in x) + "'"

    def replaced(value: str, steps) -> str:
        for pattern, new in steps:
            value = f"regexp_replace({value}, {quoted(pattern)}, {quoted(new.format('$1'))})"
        return value

    def known(value: str) -> str:
        """The identifier of a sentence or line; its normal form is made once."""
        return f"element_at(transform(array({replaced(f'lower({value})', TRIM)}), x -> {_case('x', matches)}), 1)"

    matches = "{0} RLIKE r'(?s){1}'"
    lines = f"transform(split(s, {quoted(chr(10))}), l -> {known('l')})"
    ids = F.expr(
        f"CASE WHEN text RLIKE {quoted(KNOWN)} THEN array_join(flatten(transform("
        f"filter(split({replaced('text', STEPS)}, {quoted(MARK)}), s -> s RLIKE {quoted(KNOWN)}), "
        f"s -> element_at(transform(array({known('s')}), i -> CASE WHEN i IS NULL THEN {lines} ELSE array(i) END), 1))), '><') END")
    out = docs.select("doc_id", F.coalesce(F.concat(F.lit("<"), F.nullif(ids, F.lit("")), F.lit(">")), F.lit("")).alias("sentence_ids"))
    out = out.withColumn("_rest", F.col("sentence_ids"))
    for k, (_, _, run) in enumerate(RULES):
        text = "".join(f"<{i}>" for i in run)
        out = out.withColumn(f"_r{k}", F.contains("_rest", F.lit(text))).withColumn("_rest", F.replace("_rest", F.lit(text), F.lit("")))

    def names(part: int):
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(
            *[F.when(F.col(f"_r{k}"), F.lit(rule[part])) for k, rule in enumerate(RULES)])))), ",")

    n = F.length("sentence_ids") - F.length(F.translate("sentence_ids", "<", ""))
    return out.select(
        "doc_id", n.cast("bigint").alias("n_sentences"), "sentence_ids", names(0).alias("licences"), names(1).alias("kinds"),
        F.col("_rest").alias("unmatched"))


def licences_sql() -> str:
    """The same for DuckDB over ``documents``, from the same tables."""
    steps, rest = [], "base"
    for k, (_, _, run) in enumerate(RULES):
        text = "".join(f"<{i}>" for i in run)
        steps.append(f"q{k} AS (SELECT *, contains(rest{k}, '{text}') AS r{k}, replace(rest{k}, '{text}', '') AS rest{k + 1} FROM {rest})")
        rest = f"q{k}"

    def names(part: int) -> str:
        values = ", ".join(f"CASE WHEN r{k} THEN '{rule[part]}' END" for k, rule in enumerate(RULES))
        return f"coalesce(array_to_string(list_sort(list_distinct([{values}])), ','), '')"

    def quoted(x: str) -> str:
        return " || ".join(f"chr({ord(c)})" if len(c) == 1 and ord(c) < 32 else f"'{c}'" for c in re.findall(r"[\x00-\x1f]|[^\x00-\x1f]+", x)) or "''"

    def replaced(value: str, steps) -> str:
        for pattern, new in steps:
            value = f"regexp_replace({value}, {quoted(pattern)}, {quoted(new.format(chr(92) + '1'))}, 'g')"
        return value

    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents), sentences AS (
  SELECT r, k, s, {replaced('lower(s)', TRIM)} AS x FROM (
    SELECT r, generate_subscripts(parts, 1) AS k, unnest(parts) AS s FROM (
      SELECT r, string_split({replaced("coalesce(text, '')", STEPS)}, {quoted(MARK)}) AS parts FROM d))
), whole AS (SELECT r, k, s, {_case('x', "regexp_matches({0}, '{1}')")} AS id FROM sentences
), lines AS (
  SELECT r, k, j, {replaced('lower(l)', TRIM)} AS x FROM (
    SELECT r, k, generate_subscripts(string_split(s, chr(10)), 1) AS j, unnest(string_split(s, chr(10))) AS l FROM whole WHERE id IS NULL)
), known AS (
  SELECT r, k, 0 AS j, id FROM whole WHERE id IS NOT NULL
  UNION ALL SELECT * FROM (SELECT r, k, j, {_case('x', "regexp_matches({0}, '{1}')")} AS id FROM lines) WHERE id IS NOT NULL
), ids AS (
  SELECT any_value(doc_id) AS doc_id, coalesce(list(id ORDER BY k, j) FILTER (id IS NOT NULL), []) AS ids FROM d LEFT JOIN known USING (r) GROUP BY r
), base AS (
  SELECT doc_id, coalesce(array_to_string(['<' || x || '>' FOR x IN ids], ''), '') AS sentence_ids,
    coalesce(array_to_string(['<' || x || '>' FOR x IN ids], ''), '') AS rest0, len(ids) AS n FROM ids
), {", ".join(steps)}
SELECT doc_id, CAST(n AS BIGINT) AS n_sentences, sentence_ids, {names(0)} AS licences, {names(1)} AS kinds,
  rest{len(RULES)} AS unmatched FROM {rest}
"""
