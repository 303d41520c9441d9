"""Label and code mappings, prompts and answers of the classifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code tables.
LIKERT = {1: "completamente en desacuerdo", 2: "en desacuerdo", 3: "ni de acuerdo ni en desacuerdo", 4: "de acuerdo", 5: "completamente de acuerdo"}
POLARITY = {1: "negativo", 2: "neutral", 3: "positivo"}
SCORES = {"Positive": 1, "Neutral": 0, "Negative": -1}
MODEL_LABELS = {"POS": "Positive", "NEG": "Negative"}
WEIGHTS = {1: 2.0, 0: 1.5, -1: 1.0}
DEFAULT_WEIGHT = 1.5


def _cases(column: Column, table: dict, otherwise=None) -> Column:
    out = F.lit(otherwise)
    for key, value in reversed(table.items()):
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def from_compound(score: Column) -> Column:
    return F.when(score > 0.05, "Positive").when(score < -0.05, "Negative").otherwise("Neutral")


def from_model(label: Column) -> Column:
    return _cases(label, MODEL_LABELS, "Neutral")


def from_polarity(code: Column) -> Column:
    """Sentiment names for polarity codes 3, 2 and 1; anything else is null."""
    return _cases(code.try_cast("int"), {3: "Positive", 2: "Neutral", 1: "Negative"})


def score(label: Column) -> Column:
    return _cases(label, SCORES, 0)


def weight(value: Column, default: float = DEFAULT_WEIGHT, only_default: bool = True) -> Column:
    return F.lit(float(default)) if only_default else _cases(value, WEIGHTS, float(default))


def likert_tag(code: Column) -> Column:
    return _cases(code.try_cast("int"), LIKERT)


def polarity_tag(code: Column) -> Column:
    return _cases(code.try_cast("int"), POLARITY)


def answer(response: Column) -> Column:
    """struct(classification, polarity) of 'a,b'; any other arity or null gives 'error' twice."""
    parts = F.split(response, ",")
    fine = response.isNotNull() & (F.size(parts) == 2)
    take = lambda k: F.when(fine, F.get(parts, F.lit(k))).otherwise("error")
    return F.struct(take(0).alias("classification"), take(1).alias("polarity"))


# The questions put to the model, in Spanish: two scales, two numbers, nothing else.
SCALES = (
    "Usa dos escalas. Escala de Likert: 1 = completamente en desacuerdo, 2 = en desacuerdo, 3 = ni de acuerdo ni en desacuerdo, 4 = de acuerdo, 5 = completamente de acuerdo. "
    "Escala de polaridad: 1 = negativo, 2 = neutro, 3 = positivo."
)
ANSWER = 'Contesta únicamente con dos números separados por una coma y sin espacios, como "1,2", "3,1" o "5,3": primero el de la escala de Likert y después el de la escala de polaridad.'


def video_prompt(context: str, subject: str) -> str:
    """The question for a video's summary, which follows as the message."""
    return f"Contexto: {context}\nTarea: lee el resumen de un video y clasifícalo según lo que expresa sobre esta afirmación o pregunta: \"{subject}\".\n{SCALES}\n{ANSWER}"


REPLY = "El mensaje responde a este otro: "


def comment_prompt(context: str, subject: str, stance: Column, sentiment: Column, parent: Column) -> Column:
    """The question for a comment, with its video's codes; a known parent text makes it the question for a reply."""
    reply = F.when(parent.isNull(), "").otherwise(F.concat(F.lit(REPLY), parent, F.lit("\n")))
    return F.concat(comment_opening(context, subject, stance, sentiment), reply, F.lit(f"{SCALES}\n{ANSWER}"))


def comment_opening(context: str, subject: str, stance: Column, sentiment: Column) -> Column:
    """What stands before the parent's text."""
    video = F.concat(F.lit("El video tiene un sentimiento "), F.coalesce(sentiment, F.lit("desconocido")), F.lit(" y una postura "), F.coalesce(stance, F.lit("desconocida")), F.lit(f' frente a esta afirmación o pregunta: "{subject}".\n'))
    return F.concat(F.lit(f"Contexto: {context}\nTarea: clasifica un mensaje escrito sobre un video según ese contexto. "), video)


def comment_question(opening: str, parent: str | None) -> str:
    """``comment_prompt`` from its opening, outside of Spark's expressions."""
    return opening + ("" if parent is None else f"{REPLY}{parent}\n") + f"{SCALES}\n{ANSWER}"
