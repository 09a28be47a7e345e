"""What is sent to the model: three instructions and three prompt texts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlens.functions.text import normalize_text

# Default instructions. They carry the contract the reply rules rely on (keys,
# markers, levels); callers may bring their own wording.
ANALYSIS_INSTRUCTION = """\
You read one post of an online help community. Reply with a single JSON object
holding exactly these keys:
"user_complaint": the core problem in one sentence of at most 15 words, with the
question if the author asks one;
"diagnosis": the likely root cause, not a repetition, in at most 20 words;
"cybersecurity_relevance": "High" for attacks, intrusions, leaks or concrete
vulnerabilities, "Medium" for security habits and tools, "Low" for technical
trouble with a slight security side, "None" for everything else. When in doubt
take the lower level.
If the post holds no real problem, set "user_complaint" and "diagnosis" to -1000
and "cybersecurity_relevance" to "None"."""

GENERALIZE_INSTRUCTION = """\
Rewrite a specific complaint in general terms: keep the core problem and its
human or social side, leave out technical and security details. Reply with the
rewritten complaint only."""

ANSWER_INSTRUCTION = """\
You get a complaint, its diagnosis and the comments below the post. Reply with a
single JSON object holding exactly these keys:
"Answer": the most helpful answer found in the comments, at most 50 words, or
"No relevant answer found";
"Steps": up to 5 steps if the answer has steps, else "No steps";
"Confidence": from 0 to 1, how sure you are that the answer fully solves the
complaint;
"Is_Solution": true if it definitely solves the problem, else false."""

INSTRUCTIONS = {
    "analysis": ANALYSIS_INSTRUCTION,
    "generalize": GENERALIZE_INSTRUCTION,
    "answer": ANSWER_INSTRUCTION,
}


# The labels of the three prompts and what stands for absent text.
TITLE = "Title: "
CONTENT = "\n\nContent: "
SPECIFIC = "Specific complaint: "
REQUEST = "\nProvide a more general version:"
COMPLAINT = "User Complaint: "
DIAGNOSIS = "\nDiagnosis: "
COMMENTS = "\nComments: "
ABSENT = "None"


def _shown(text: Column) -> Column:
    return F.coalesce(text, F.lit(ABSENT))


def analysis_prompt(title: Column, self_text: Column) -> Column:
    return F.concat(
        F.lit(TITLE),
        _shown(normalize_text(title)),
        F.lit(CONTENT),
        _shown(normalize_text(self_text)),
    )


def generalize_prompt(complaint: Column) -> Column:
    return F.concat(
        F.lit(SPECIFIC),
        _shown(complaint),
        F.lit(REQUEST),
    )


def answer_prompt(complaint: Column, diagnosis: Column, comments: Column) -> Column:
    return F.concat(
        F.lit(COMPLAINT),
        _shown(complaint),
        F.lit(DIAGNOSIS),
        _shown(diagnosis),
        F.lit(COMMENTS),
        comments,
    )
