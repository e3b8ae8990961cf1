"""Prompts as column expressions.  The wording is this package's own; what replies must look like is what the parsers read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REPLY = "Reply with one line: `Final Answer: <name, value, Yes or No>` and nothing else."
NOTHING = "No specific context found."


def _joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def seed_choice(question: Column, candidates: Column, most: int = 5) -> Column:
    """``candidates``: one line ``ID n: name (Info: ...)`` each; the reply is a list of their numbers."""
    return _joined(f"Choose 1 to {most} entities to start from; prefer specific names to general ones.\nQuestion: ", question, "\nCandidates:\n", candidates, "\nReply with their numbers, separated by commas.")


def candidate_line(number: Column, name: Column, description: Column, longest: int | None = 200) -> Column:
    text = F.translate(description, "\n", " ")
    return _joined("ID ", number, ": ", name, " (Info: ", F.substring(text, 1, longest) if longest else text, ")")


def decision(question: Column, stage: Column, history: Column, candidates: Column, evidence: Column) -> Column:
    """A stage of the walk: answer, or name relevant and next nodes."""
    return _joined(
        "Question: ", question, "\nStage: ", stage, "\nKnown facts:\n", history, "\nCandidate nodes:\n", candidates, "\nEvidence:\n", evidence,
        "\nIf the facts answer the question: `Final Answer: <answer>`. If not: `Relevant Nodes: [a; b]` and `Next Hop: [c; d]` from the candidates.",
    )


def grounded(question: Column, definitions: Column | None, references: Column) -> Column:
    """Answer from reference texts, with definitions of entities where there are any."""
    known = ["\nEntities:\n", definitions] if definitions is not None else []
    return _joined("Answer from the references alone.\nQuestion: ", question, *known, "\nReferences:\n", F.coalesce(F.nullif(references, F.lit("")), F.lit(NOTHING)), "\n" + REPLY)


def direct(question: Column) -> Column:
    return _joined("Answer briefly and exactly.\nQuestion: ", question, "\n" + REPLY)


def coreference(text: Column) -> Column:
    return _joined("Replace every pronoun by the name it stands for and change nothing else. Reply with the text.\n", text)


def concepts(text: Column) -> Column:
    return _joined('List the entities of the text as JSON: [{"entity": "", "category": "", "description": "", "synonyms": []}].\n', text)


def relations(text: Column, names: Column) -> Column:
    return _joined('List the relations between the named entities as JSON: [{"node_1": "", "node_2": "", "edge": ""}]. Use the standard names.\nNames: ', names, "\nText: ", text)


def kind(question: Column, kinds: tuple[str, ...]) -> Column:
    return _joined(f"Which kind of question is this: {', '.join(kinds)}? Reply with one word.\n", question)
