"""The registered queries of this package: thin, each by way of its operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from mostrador.llm import (
    bpe, chat, divergence, exact_dedup, hard_negatives, licences, mixing, near_dedup, quality, spotsigs, suffix_dedup,
    target_resampling, toxicity)
from mostrador.llm.common import plain_text, stored, table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run
    return register


@query("op10_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def streamed(turns: DataFrame) -> DataFrame:
    """The log of a session that ends in these turns (conv_id, place, role, text): the fold has to give them back.

    An assistant's text is begun, regenerated and streamed in two deltas. Any other turn is sent half written and gets a
    reply; then it is edited, which withdraws the reply.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    begun, rest = F.left(F.col("text"), half), F.substr(F.col("text"), half + 1)
    nothing = F.lit(None).cast("string")
    def event(step, kind, role, text, turn=F.col("place")):
        return F.struct((4 * F.col("place") + step).alias("seq"), F.lit(kind).alias("kind"), turn.alias("turn"),
                        role.alias("role"), text.alias("text"))
    said = F.array(event(0, "message", F.col("role"), begun), event(1, "regenerate", nothing, nothing),
                   event(2, "delta", F.col("role"), begun), event(3, "delta", nothing, rest))
    asked = F.array(event(0, "message", F.col("role"), begun),
                    event(1, "message", F.lit("assistant"), F.left(F.col("text"), F.lit(40)), F.col("place") + 1),
                    event(2, "edit", F.col("role"), F.col("text")))
    return turns.select("conv_id", F.inline(F.when(F.col("role") == "assistant", said).otherwise(asked)))


@query("op2_chat_formatting", r"""
    WITH rows AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), marked AS (
        SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|', '<\|'),
            '<s>', '<\s>'), '</s>', '<\/s>'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>'), '[INST]', '[\INST]'),
            '[/INST]', '[\/INST]') AS body FROM rows
    ), joined AS (
        SELECT conv_id, count(*) AS n_turns, sum(length(body) + length(role) + 33) AS formatted_chars,
               string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
               coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss
        FROM marked GROUP BY conv_id
    )
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
           sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM joined
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``conversations`` is a logged turn, see :func:`streamed`; the digests are taken from the rendered text."""
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(turn).cast("long").alias("turn"),
                 F.lit(role).alias("role"), F.lit(control).alias("text"))
        for turn, role in enumerate(("user", "assistant"))])))
    logged = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    events = streamed(logged.withColumn("place", place.cast("long")))
    out = chat.render(chat.fold_events(events))
    back = out.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"),
                      chat.read_turns(F.col("formatted")).alias("turns"),
                      chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       "formatted_chars")


def token_digests(docs: DataFrame) -> DataFrame:
    done = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return done.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


@query("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), share=85)


@query("op6_mixing", mixing.sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.sampling(table(spark, sf_dir, "documents"), part=mixing.BUDGET)
    return drawn.withColumns({c: F.round(c, 6) for c in ("weight", "probability")})


@query("op4_suffix_array")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                       F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= toxicity.TOXIC_FROM).cast("int").alias("predicted"),
                         F.size("offending").alias("n_offending"))


@query("op3_fingerprints")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


@query("op8_licences", licences.sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = stored(licences.with_units(licences.bound_files(table(spark, sf_dir, "documents"))))
    return files.select("doc_id", "path").join(licences.inherit(files.select("path", "units")), "path").select(
        "doc_id", "path", "licence", "score", "how", "from_path")


@query("op11_resampling", r"""
    WITH bytes AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i:
            CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b::BIGINT)) AS crc_table),
    listed AS (
        SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
    ), aimed AS (
        SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
    ), counted AS (SELECT row_id, unnest(words) AS word FROM listed),
    hexed AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM (SELECT word FROM counted UNION ALL SELECT word FROM aimed)),
    hashed AS (
        SELECT word, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
            lambda c, b: xor(c >> 8, crc_table[1 + xor(c & 255, b)]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
        FROM hexed, bytes
    ), corpus AS (SELECT bucket, count(*) AS s FROM counted JOIN hashed USING (word) GROUP BY bucket),
    target AS (SELECT bucket, count(*) AS t FROM aimed JOIN hashed USING (word) GROUP BY bucket),
    gains AS (
        SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM corpus) + 10000)::DOUBLE
            / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM target) + 10000)::DOUBLE)))::BIGINT AS gain
        FROM corpus FULL JOIN target USING (bucket)
    ), weighed AS (
        SELECT row_id, sum(gain)::BIGINT AS weight FROM counted JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY row_id
    ), scored AS (
        SELECT doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
            (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
        FROM listed LEFT JOIN weighed USING (row_id)
    ), placed AS (
        SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () * 10 // 100 AS drawn
        FROM scored WHERE n_features >= 20
    )
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM placed
    UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_features < 20
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_hard_negatives", """
    WITH held AS (
        SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
               list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vector
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scores AS (
        SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS alike,
               list_dot_product(a.vector, c.vector)::BIGINT AS score
        FROM held a JOIN held c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
    ), positives AS (
        SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE alike
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
    )
    SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank,
           other_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scores USING (anchor_id)
    WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose vec_id is divisible by 7 have the next label, so that near rows of another label are there to find."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), label)


@query("op13_quality_rules", r"""
    WITH texts AS (
        SELECT row_number() OVER () AS row_id, doc_id, coalesce(lang, '') AS language, coalesce(text, '') AS t FROM documents
    ), split AS (
        SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
               [length(regexp_replace(t, '[^\p{Ll}]', '', 'g')), length(regexp_replace(t, '[^\p{Lu}\p{Lt}]', '', 'g')),
                length(regexp_replace(t, '[^\p{Lm}\p{Lo}\p{M}]', '', 'g')), length(regexp_replace(t, '[^\p{N}]', '', 'g')),
                length(regexp_replace(t, '[^\x09-\x0D\p{Z}]', '', 'g')), length(regexp_replace(t, '[^.,;:''"()-]', '', 'g')),
                length(regexp_replace(t, '[^\p{P}]|[.,;:''"()-]', '', 'g')), length(regexp_replace(t, '[^\p{S}]', '', 'g'))] AS known
        FROM texts
    ), counted AS (SELECT *, len(words) AS n_words, list_append(known, length(t) - list_sum(known)) AS classes FROM split),
    words AS (
        SELECT row_id, doc_id, language, unnest(words) AS word, unnest(range(len(words))) AS place FROM counted
    ), windows AS (
        SELECT row_id, place, lead(place, 4) OVER w AS last, [word, lead(word, 1) OVER w, lead(word, 2) OVER w,
               lead(word, 3) OVER w, lead(word, 4) OVER w] AS run FROM words WINDOW w AS (PARTITION BY row_id ORDER BY place)
    ), twice AS (SELECT row_id, place FROM windows WHERE last IS NOT NULL QUALIFY count(*) OVER (PARTITION BY row_id, run) > 1),
    repeated AS (SELECT row_id, count(DISTINCT place + i) AS n FROM twice, range(5) AS steps(i) GROUP BY row_id),
    lines AS (
        SELECT row_id, count(*) - count(DISTINCT line) AS n FROM (SELECT row_id, unnest(string_split(t, chr(10))) AS line FROM texts)
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row_id
    ), good AS (
        SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1
    ), common AS (
        SELECT language, lower(word) AS bar, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY language) AS n_words
        FROM words SEMI JOIN good USING (doc_id) GROUP BY language, bar
        QUALIFY row_number() OVER (PARTITION BY language ORDER BY n DESC, bar) <= 50 AND n_words >= 1000
    ), bars AS (  -- of each language: its common words and all others, then its classes
        SELECT language, 'word' AS kind, bar, n FROM common
        UNION ALL SELECT language, 'word', NULL, any_value(n_words) - sum(n) FROM common GROUP BY language
        UNION ALL SELECT language, 'class', i::VARCHAR, sum(classes[i]) FROM counted SEMI JOIN good USING (doc_id), range(1, 10) AS r(i)
        WHERE language IN (SELECT language FROM common) GROUP BY language, i
    ), own AS (
        SELECT row_id, 'word' AS kind, c.bar, count(*)::DOUBLE AS n FROM words w LEFT JOIN common c ON c.language = w.language
        AND c.bar = lower(w.word) WHERE w.language IN (SELECT language FROM common) GROUP BY row_id, c.bar
        UNION ALL SELECT row_id, 'class', i::VARCHAR, classes[i] FROM counted, range(1, 10) AS r(i)
    ), beside AS (
        SELECT c.row_id, b.kind, coalesce(o.n, 0) / sum(coalesce(o.n, 0)) OVER d AS p, b.n / sum(b.n) OVER d AS q
        FROM counted c JOIN bars b ON b.language = c.language AND c.n_words >= 50
        LEFT JOIN own o ON o.row_id = c.row_id AND o.kind = b.kind AND o.bar IS NOT DISTINCT FROM b.bar
        WINDOW d AS (PARTITION BY c.row_id, b.kind)
    ), far AS (
        SELECT row_id, kind, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
               + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS distance FROM beside GROUP BY row_id, kind
    ), ruled AS (
        SELECT doc_id, n_words, (length(t) - length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g'))) AS word_chars,
               length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines,
               coalesce(r.n, 0) AS n_repeat_words, n_words < 10 OR 100 * coalesce(r.n, 0) > 20 * n_words AS base_failed,
               w.distance AS word_distance, k.distance AS class_distance
        FROM counted c LEFT JOIN lines l USING (row_id) LEFT JOIN repeated r USING (row_id)
        LEFT JOIN far w ON w.row_id = c.row_id AND w.kind = 'word' LEFT JOIN far k ON k.row_id = c.row_id AND k.kind = 'class'
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND coalesce(word_distance <= 0.12 + sqrt(50 / (8 * ln(2) * n_words)), true)
           AND coalesce(class_distance <= 0.06 + sqrt(4.0 / n_words), true) AS kept,
           round(word_distance, 6) AS word_distance, round(class_distance, 6) AS class_distance
    FROM ruled
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = divergence.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.withColumns({c: F.round(c, 6) for c in ("word_distance", "class_distance")})
