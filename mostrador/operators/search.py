"""Many name searches at once, by postings of short runs of letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Letters of the longest run that is posted.
RUN = 3


def runs(text: Column, n: int) -> Column:
    """The distinct runs of ``n`` letters of a text; none where it is shorter."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))))


def search_many(products: DataFrame, searches: DataFrame) -> DataFrame:
    """For every distinct ``texto`` of ``searches`` the products whose name contains it in any letter case:
    texto and the columns of ``products``.

    Wildcards are literal. A text of three letters or more meets the names under its rarest run of three; what comes
    up must also have its second rarest run, and is then tested against the name itself. Shorter texts meet the names
    under themselves, the empty text all names. Names are posted only under runs that a text opens with or asks for,
    so no name meets a text without a run in common. Equal names are posted once. A NULL name or text matches nothing;
    repeated products come as often as they are there. A column texto of the products would clash and is left out.
    """
    name = F.lower("nomprod")
    texts = searches.select("texto").where("texto IS NOT NULL").distinct().withColumn("_low", F.lower("texto"))
    asked = texts.withColumn("_run", F.explode(F.coalesce(runs(F.col("_low"), RUN), F.array("_low"))))
    wanted = asked.select("_run").distinct()
    named = products.where("nomprod IS NOT NULL").drop("texto")
    parts = [F.coalesce(runs(F.col("_name"), n), F.array().cast("array<string>")) for n in range(1, RUN + 1)]
    postings = (named.select(name.alias("_name")).distinct()
                .select("_name", F.explode(F.concat(F.array(F.lit("")), *parts)).alias("_run"))
                .join(wanted, "_run", "left_semi"))
    spread = postings.groupBy("_run").agg(F.count("*").alias("_names"))
    # A text with a run that no name has matches nothing: fewer runs are found than were asked for.
    ranked = (asked.groupBy("texto", "_low").agg(F.count("*").alias("_runs"))
              .join(asked.join(spread, "_run").groupBy("texto").agg(
                  F.sort_array(F.collect_list(F.struct("_names", "_run"))).alias("_found")), "texto")
              .where(F.size("_found") == F.col("_runs"))
              .select("texto", "_low", F.col("_found")[0]["_run"].alias("_run"),
                      F.coalesce(F.get("_found", F.lit(1))["_run"], F.col("_found")[0]["_run"]).alias("_second")))
    opened = postings.join(ranked, "_run").select("_name", "texto", "_low", F.col("_second").alias("_run"))
    both = opened.join(postings, ["_name", "_run"], "left_semi")
    met = both.where(F.col("_name").contains(F.col("_low"))).select("_name", "texto")
    return (named.withColumn("_name", name).join(met, "_name")
            .select("texto", *[F.col(f"`{c}`") for c in products.columns if c != "texto"]))
