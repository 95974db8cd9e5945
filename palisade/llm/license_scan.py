"""License scans by diagonal voting, with DataFrame operations only (operator 4).

Contract.  ``scan(docs)`` returns for every row ``doc_id``, ``n_words``, ``n_base`` (places where a
base phrase stands), ``first_word`` and ``last_word`` (least and greatest start of such a place,
words from 0; null if none), ``base_labels``, ``labels`` (with those of notices found by voting;
distinct, sorted, comma-joined) and ``score`` (0 to 1: 1 for a base phrase, else the share of a
notice's word k-grams that the best verified span holds).

Method.  Phrases and notices are templates.  One scan of the documents hashes every rolling run of
``K`` words and keeps, in the row, the places whose hash any template has (a semi-join with a list
of fixed size).  These places join the templates' positions; votes are counted by document,
template and diagonal (place less template position); neighbouring diagonals of a notice, whose
words were inserted or left out, are merged (a group that stray k-grams stretch far beyond the notice
is split again, into every diagonal with its neighbours); spans are then verified on the words
themselves, and of notices that overlap the nearest one counts: the one with the most votes, each
k-gram of the template counted once at most, then with the greatest share.  Base phrases take one
diagonal with all its votes and word-for-word equality.

The templates are constants of this module or a parameter of at most ``MOST_WORDS`` words, so the
broadcast is bounded.
Only rows with a hit carry their words to the second phase, and nothing is shuffled but votes.

Edge cases: null and empty texts have no words; texts shorter than a phrase have no place; every
place in a long text counts; rows are told apart by a number of their own, so repeated rows and ids
are each returned; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import scratch

#: Words of a rolling run, diagonals between votes that still belong together, least share of votes
#: and of distinct words of a notice, longest span against the notice's length.
K, SLACK, VOTES, WORDS, STRETCH = 3, 3, 0.6, 0.8, 1.6

#: Words that all templates may have together.
MOST_WORDS = 100_000

# Base phrases and their labels; notices and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2",
    "licensed under the apache license version 2 0": "apache-2",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the gnu general public license version 2": "gpl-2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under the gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "released under the bsd license": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "bsl-1",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software": "zlib",
    "this program and the accompanying materials are made available under the terms of the eclipse public license": "epl",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "licensed under a creative commons attribution 4 0 international license": "cc-by",
    "licensed under a creative commons attribution noncommercial sharealike 4 0 international license": "cc-by-nc-sa",
    "licensed under a creative commons attribution noncommercial noderivatives 4 0 international license": "cc-by-nc-nd",
    "licensed under a creative commons attribution noderivatives 4 0 international license": "cc-by-nd",
    "waived all copyright and related or neighboring rights to this work": "cc0",
    "spdx license identifier mit": "mit",
    "spdx license identifier apache 2 0": "apache-2",
    "spdx license identifier bsd 3 clause": "bsd",
    "spdx license identifier bsd 2 clause": "bsd",
    "spdx license identifier isc": "isc",
    "spdx license identifier mpl 2 0": "mpl-2",
    "spdx license identifier gpl 2 0": "gpl-2",
    "spdx license identifier gpl 3 0": "gpl-3",
    "spdx license identifier lgpl 2 1": "lgpl",
    "spdx license identifier lgpl 3 0": "lgpl",
    "spdx license identifier agpl 3 0": "agpl",
    "spdx license identifier bsl 1 0": "bsl-1",
    "spdx license identifier cc by 4 0": "cc-by",
    "spdx license identifier cc by sa 4 0": "cc-by-sa",
    "spdx license identifier cc0 1 0": "cc0",
}
#: What is not in a word.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The one sign outside A-Z that lower() turns into an ASCII letter, and a stand-in.
_KELVIN, _STAND_IN = "K", "ĸ"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null has none."""
    low = F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit(_KELVIN), F.lit(_STAND_IN)))
    return F.filter(F.split(low, BREAK), lambda w: w != "")


def _grams(words: Column) -> Column:
    """(pos, h) of all rolling runs of K words."""
    hashed = lambda i: F.struct(i.alias("pos"), F.xxhash64(*(F.get(words, i + j) for j in range(K))).alias("h"))
    last = F.size(words) - K
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), hashed)).otherwise(F.array().cast("array<struct<pos:int,h:bigint>>"))


def templates(spark, notices: dict[str, str]) -> DataFrame:
    """(tid, label, base, twords): all phrases and notices."""
    every = [*((t, x, True) for t, x in PHRASES.items()), *((t, x, False) for t, x in notices.items())]
    rows = [(i, label, base, text.split()) for i, (text, label, base) in enumerate(every)]
    if any(len(words) < K for *_, words in rows) or sum(len(words) for *_, words in rows) > MOST_WORDS:
        raise ValueError(f"a template needs {K} words, all templates may have {MOST_WORDS}")
    return spark.createDataFrame(rows, "tid int, label string, base boolean, twords array<string>")


def scan(docs: DataFrame, notices: dict[str, str] | None = None) -> DataFrame:
    """See the module's docstring.  notices: words in lower case with one blank between, and their labels."""
    spark = docs.sparkSession
    known = templates(spark, NOTICES if notices is None else notices)
    positions = known.select("tid", F.explode(_grams(F.col("twords"))).alias("g")).select("tid", F.col("g.h").alias("h"), F.col("g.pos").alias("tpos"))
    wanted = [r.h for r in positions.select("h").distinct().orderBy("h").collect()]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "words", F.filter(_grams(F.col("words")), lambda g: g["h"].isin(wanted)).alias("hits"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), "hits", F.when(F.size("hits") > 0, F.col("words")).alias("words"))
    rows = scratch.keep(rows, "license-hits")

    votes = rows.where(F.size("hits") > 0).select("row", F.explode("hits").alias("g")).select("row", F.col("g.pos").alias("pos"), F.col("g.h").alias("h"))
    votes = votes.join(F.broadcast(positions), "h").withColumn("diag", F.col("pos") - F.col("tpos"))
    diagonals = votes.groupBy("row", "tid", "diag").agg(F.count("*").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    diagonals = diagonals.join(F.broadcast(known.select("tid", "label", "base", F.size("twords").alias("n"), "twords")), "tid")

    exact = diagonals.where(F.col("base") & (F.col("votes") == F.col("n") - (K - 1)))
    spans = exact.select("row", "label", "base", "twords", F.col("lo").alias("lo"), (F.col("lo") + F.col("n") - 1).alias("hi"), F.col("votes").cast("long").alias("votes"), F.lit(1.0).alias("share"))
    order = Window.partitionBy("row", "tid").orderBy("diag")
    near = diagonals.where(~F.col("base")).withColumn("new", (F.coalesce(F.col("diag") - F.lag("diag").over(order), F.lit(SLACK + 1)) > SLACK).cast("int"))
    near = near.withColumn("group", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    own = ["row", "tid", "group"]
    merged = near.groupBy(*own).agg(F.sum("votes").alias("votes"), F.min("lo").alias("lo"), (F.max("hi") + K - 1).alias("hi"), *(F.first(c).alias(c) for c in ("label", "base", "twords", "n")))
    merged = merged.withColumn("share", F.least(F.lit(1.0), F.col("votes") / (F.col("n") - (K - 1)))).where(F.col("share") >= VOTES)
    long = F.col("hi") - F.col("lo") + 1 > STRETCH * F.col("n")
    # stray k-grams beside a notice stretch its group: there, each diagonal counts with its neighbours only
    beside = Window.partitionBy(*own).orderBy("diag").rangeBetween(-SLACK, SLACK)
    split = near.join(merged.where(long).select(*own), own)
    split = split.select(*own, "label", "base", "twords", "n", F.sum("votes").over(beside).alias("votes"), F.min("lo").over(beside).alias("lo"), (F.max("hi").over(beside) + K - 1).alias("hi"))
    split = split.withColumn("share", F.least(F.lit(1.0), F.col("votes") / (F.col("n") - (K - 1)))).where((F.col("share") >= VOTES) & ~long)
    once = F.least("votes", F.col("n") - (K - 1)).cast("long")
    merged, split = merged.where(~long).withColumn("votes", once), split.withColumn("votes", once)
    spans = spans.unionByName(merged.select(*spans.columns)).unionByName(split.select(*spans.columns).distinct())

    held = rows.where("words is not null").select("row", "words")
    seen = F.slice("words", F.col("lo") + 1, F.col("hi") - F.col("lo") + 1)
    same = F.when(F.col("base"), seen == F.col("twords")).otherwise(F.size(F.array_intersect(seen, "twords")) >= WORDS * F.size(F.array_distinct("twords")))
    good = spans.join(held, "row").where(same).select("row", "label", "base", "lo", "hi", "votes", "share")
    # overlapping notices: runs of spans whose starts do not pass the ends so far
    order = Window.partitionBy("row").orderBy("lo", "hi", "label")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rival = good.where(~F.col("base")).withColumn("new", F.coalesce(F.col("lo") > reach, F.lit(True)).cast("int"))
    rival = rival.withColumn("group", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    best = rival.groupBy("row", "group").agg(F.max(F.struct("votes", "share", "label", "lo")).alias("x"))
    good = good.where("base").select("row", "label", "base", "lo", "share").unionByName(best.select("row", "x.label", F.lit(False).alias("base"), "x.lo", "x.share"))
    own = F.when(F.col("base"), F.col("lo")).cast("long")
    found = good.groupBy("row").agg(
        F.count(own).alias("n_base"), F.min(own).alias("first_word"), F.max(own).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("share").alias("score"),
    )
    out = rows.select("row", "doc_id", "n_words").join(found, "row", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
