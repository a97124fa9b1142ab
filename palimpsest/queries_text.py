"""Queries over free text: spans by pattern, and names by a tagger that is trained and tested on planted ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import entities, tagger
from palimpsest.registry import PACK, query, table

CYRILLIC, LATIN = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "abvgdeejziiklmnoprstufhccss_y_eua"
#: What is planted: text, and in braces the kind of name. L, F, P: last, first name, patronymic; C, S: town, street.
PLANTED = [
    "Клиент {L} {F} {P} живёт в г. {C}, договор Срочный.",
    "Посылка для {F} {L} ушла в город {C} вчера.",
    "Manager {f} {l} moved to {c} in May.",
    "Звонить {L} {F}, адрес: ул. {S}, дом 5.",
    "Отдел Продаж закрыт, Договор подписан в Среду. Monday Report.",
    "Report Monday says Team Orange won. Ask {l} {f} from {c} today.",
]
#: How a text of every third document is used: the others are learned from.
HELD_OUT = "doc_id % 3 = 1"


def _name(component: str, held_out: Column, k: Column) -> Column:
    """A name of a list; held-out texts get those that no other text does."""
    values = PACK.components[component]
    lists = [F.array(*[F.lit(v) for v in values[odd::2]]) for odd in (0, 1)]
    return F.when(held_out, F.element_at(lists[1], (F.pmod(k, F.size(lists[1])) + 1).cast("int"))).otherwise(F.element_at(lists[0], (F.pmod(k, F.size(lists[0])) + 1).cast("int")))


def planted(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` with a sentence before or behind it, and ``spans`` of the names in that sentence."""
    k, held = F.floor(F.col("doc_id") / 3), F.expr(HELD_OUT)  # all sentences on both sides
    of = {"L": ("last_name_male", 1), "F": ("first_name_male", 7), "P": ("patronymic_male", 3), "C": ("city", 5), "S": ("street", 11)}
    names = {key: _name(component, held, F.floor(k / 6) * step) for key, (component, step) in of.items()}
    names |= {key.lower(): F.initcap(F.translate(F.lower(value), CYRILLIC, LATIN)) for key, value in names.items()}
    text, spans = F.lit(""), F.array().cast("array<struct<type:string,start:int,stop:int>>")
    for n, template in enumerate(PLANTED):
        said, marks, open_ = F.lit(""), [], None
        for piece in template.replace("}", "{").split("{"):
            if piece in names:
                start = F.length(said)
                said = F.concat(said, names[piece])
                kind = "LOCATION" if piece in "CScs" else "PERSON"
                # names that follow each other are one person
                marks, open_ = (marks[:-1] + [(kind, marks[-1][1], F.length(said))], kind) if open_ == kind else (marks + [(kind, start, F.length(said))], kind)
            else:
                said = F.concat(said, F.lit(piece))
                open_ = open_ if piece == " " else None
        found = F.array(*[F.struct(F.lit(kind).alias("type"), a.cast("int").alias("start"), b.cast("int").alias("stop")) for kind, a, b in marks]) if marks else spans
        text, spans = F.when(k % 6 == n, said).otherwise(text), F.when(k % 6 == n, found).otherwise(spans)
    at = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("body"), text.alias("said"), spans.alias("said_spans"))
    ahead = F.when(F.floor(k / 6) % 2 == 0, F.lit(0)).otherwise(F.length("body") + 1)
    moved = F.transform("said_spans", lambda s: F.struct(s["type"].alias("type"), (s["start"] + ahead).cast("int").alias("start"), (s["stop"] + ahead).cast("int").alias("stop")))
    return at.select("doc_id", F.when(ahead == 0, F.concat_ws("\n", "said", "body")).otherwise(F.concat_ws("\n", "body", "said")).alias("text"), moved.alias("spans"))


def _tagged(spark, sf_dir) -> DataFrame:
    """Spans found in held-out documents and those planted there: ``doc_id``, ``type``, ``start``, ``stop``, ``found``, ``planted``."""
    docs = planted(table(spark, sf_dir, "documents"))
    model = tagger.train(docs.where(f"not ({HELD_OUT})"))
    held = entities.spans(docs.where(HELD_OUT), "text", model, recognisers=[])
    got = held.select("doc_id", F.explode("entities").alias("e")).where("e.score >= 0.6").select("doc_id", "e.type", "e.start", "e.stop", F.lit(True).alias("found"))
    want = docs.where(HELD_OUT).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.type", "s.start", "s.stop", F.lit(True).alias("planted"))
    return want.join(got, ["doc_id", "type", "start", "stop"], "full")


@query(f"SELECT 'LOCATION' AS type, count(*) FILTER (doc_id // 3 % 6 <> 4) AS planted, true AS recalled, true AS precise FROM documents WHERE {HELD_OUT} UNION ALL SELECT 'PERSON', count(*) FILTER (doc_id // 3 % 6 <> 4), true, true FROM documents WHERE {HELD_OUT}")
def tagged_names(spark, sf_dir):
    """Whether at least nine tenths of planted names, none of which was seen in training, are found to the letter, and
    as many of the spans found are planted ones."""
    of = _tagged(spark, sf_dir).groupBy("type").agg(F.count("planted").alias("planted"), F.count("found").alias("found"), F.count_if(F.col("found") & F.col("planted")).alias("both"))
    return of.select("type", "planted", (F.col("both") >= 0.9 * F.col("planted")).alias("recalled"), (F.col("both") >= 0.9 * F.col("found")).alias("precise"))


#: Numbers behind words that make them personal, one to a document.
SAID = """concat(text, CASE doc_id % 7 WHEN 0 THEN ' ИНН клиента ' WHEN 1 THEN ' Снилс: ' WHEN 2 THEN ' паспорт серия и номер ' WHEN 3 THEN ' звонить сегодня по ' WHEN 4 THEN ' оплата картой ' WHEN 5 THEN ' адрес узла ' ELSE ' инн не указан, а число без всякого отношения к нему: ' END,
 CASE doc_id % 7 WHEN 0 THEN concat('7700', lpad(CAST(doc_id AS STRING), 8, '0')) WHEN 1 THEN concat('112-233-', lpad(CAST(doc_id % 1000 AS STRING), 3, '0'), ' 95') WHEN 2 THEN concat('4509 ', lpad(CAST(doc_id AS STRING), 6, '1')) WHEN 3 THEN concat('8900', lpad(CAST(doc_id AS STRING), 7, '5'))
 WHEN 4 THEN concat('4111 1111 1111 ', lpad(CAST(doc_id % 10000 AS STRING), 4, '0')) WHEN 5 THEN concat('10.20.', doc_id % 300, '.7 и https://x.example/', doc_id) ELSE concat('7700', lpad(CAST(doc_id % 1000000 AS STRING), 6, '0')) END)"""


@query(rf"""
WITH r(type, pattern, score, words) AS (VALUES
  ('EMAIL_ADDRESS', '[\w.+-]+@[\w-]+(?:\.[\w-]+)+', 1.0, []::VARCHAR[]),
  ('IP_ADDRESS', '\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b', 0.6, []),
  ('URL', '\bhttps?://[^\s<>"]+', 0.6, []),
  ('CREDIT_CARD', '\b\d{{4}}[ -]?\d{{4}}[ -]?\d{{4}}[ -]?\d{{4}}\b', 0.3, ['card', 'visa', 'карта', 'карты']),
  ('PHONE_NUMBER', '\+7\d{{10}}', 0.85, ['телефон', 'тел', 'звонить', 'перезвонить', 'моб']),
  ('PHONE_NUMBER', '\b8\d{{10}}\b', 0.6, ['телефон', 'тел', 'звонить', 'перезвонить', 'моб']),
  ('RU_INN', '\b\d{{12}}\b', 0.5, ['инн', 'налогоплательщик']),
  ('RU_INN', '\b\d{{10}}\b', 0.35, ['инн', 'налогоплательщик']),
  ('RU_SNILS', '\b\d{{3}}-\d{{3}}-\d{{3}}\s\d{{2}}\b', 0.9, ['снилс', 'пенсионн']),
  ('RU_PASSPORT', '\b\d{{4}}\s\d{{6}}\b', 0.6, ['паспорт', 'серия', 'номер'])
), d AS (SELECT doc_id, {SAID} AS text FROM documents),
m AS (SELECT *, regexp_extract_all(text, pattern) AS found, string_split_regex(text, pattern) AS gaps FROM d, r),
e AS (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM m),
s AS (SELECT *, CAST(list_sum([len(x) for x in gaps[1:k]]) + coalesce(list_sum([len(x) for x in found[1:k - 1]]), 0) AS INTEGER) AS start FROM e),
c AS (SELECT *, regexp_extract_all(lower(substr(text, greatest(1, start - 199), least(200, start))), '[\pL\pN_]+') AS before FROM s)
SELECT doc_id, type, start, CAST(start + len(found[k]) AS INTEGER) AS stop,
  CAST(CASE WHEN len([w for w in words if len([b for b in before[-5:] if contains(b, w)]) > 0]) > 0 THEN least(1.0, score + 0.35) ELSE score END AS DOUBLE) AS score
FROM c
""")
def pattern_spans(spark, sf_dir):
    """Every match of a pattern in documents with a number behind it, with its place and score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(SAID).alias("text"))
    found = entities.spans(docs, "text", overlaps=True).select("doc_id", F.explode("entities").alias("e"))
    return found.select("doc_id", "e.type", "e.start", "e.stop", "e.score")
