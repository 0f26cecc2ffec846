"""Structure of code documents, read from their token stream.

Statements are found lexically. Everything that depends only on neighbouring tokens is settled
inside the row: the tokens become a string with one character per token, regular expressions mark
where a statement can start and of which kind it is, and all other characters are dropped. Only
this short event string is shuffled, once, by document; nesting depth then comes from running sums
over its events, and the per-document aggregate uses the same partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from likeness.functions.cutting import counted_tokens, token_coder
from likeness.operators.joins import dealt
from likeness.operators.tokens import explode_with_position, with_tokens

# Words of the analysed language.
PRIMITIVE_TYPES = ["void", "int", "String", "boolean", "double", "float", "char", "byte", "short", "long"]
MODIFIERS = ["public", "private", "protected", "static", "final", "synchronized", "volatile", "transient"]

# One character per token. Keywords carry the small letter of the statement kind they open.
WORD_CODES = {
    "package": "p",
    "import": "i",
    "class": "k",
    "if": "q",
    "for": "f",
    "while": "w",
    "return": "r",
    "try": "t",
    "System": "s",
    "java": "j",
    "else": "h",
    "catch": "n",
    "finally": "n",
    "throws": "n",
    "(": "(",
    ")": ")",
    "{": "{",
    "}": "}",
    ";": ";",
    ",": ",",
    "=": "=",
    **{word: "y" for word in PRIMITIVE_TYPES},
    **{word: "" for word in MODIFIERS},
}

# Statement kinds and the letter each has in a kind sequence.
KIND_NAMES = {
    "P": "PackageDeclaration",
    "I": "ImportDeclaration",
    "K": "ClassDeclaration",
    "M": "MethodDeclaration",
    "V": "VariableDeclaration",
    "Q": "IfStatement",
    "F": "ForStatement",
    "W": "WhileStatement",
    "R": "ReturnStatement",
    "T": "TryStatement",
    "S": "SystemCall",
    "J": "JavaCall",
    "L": "MethodCall",
    "E": "ExpressionStatement",
    "C": "Condition",
    "B": "BlockStatement",
}
STATEMENT_KINDS = "QFWRSJEL"
BODY_KINDS = STATEMENT_KINDS + "VT"

# The named n-grams and the kinds they count.
NAMED_NGRAMS = {
    "system_if": "SQ",
    "vardec_while": "VW",
    "vardec_if": "VQ",
    "expression_expression": "EE",
    "expression_if": "EQ",
    "for_cond_block_if": "FCBQ",
    "vardec_for_cond_block": "VFCB",
    "if_cond_block_system_": "QCBS",
    "if_cond_block_if": "QCBQ",
    "if_cond_block_while": "QCBW",
    "if_cond_block_vardec": "QCBV",
    "while_cond_block_if": "WCBQ",
    "vardec_if_cond_block": "VQCB",
    "while_cond_block_vardec": "WCBV",
    "expression_expression_expression_expression": "EEEE",
}

COUNTED_KINDS = {
    "num_methods": "M",
    "num_if": "Q",
    "num_for": "F",
    "num_while": "W",
    "num_return": "R",
    "num_imports": "I",
    "num_package": "P",
    "num_expressions": "E",
    "num_systemcall": "S",
    "num_javacall": "J",
    "num_variables": "V",
    "num_method_calls": "L",
}


CODER = token_coder(WORD_CODES, PRIMITIVE_TYPES)


def token_code(token: Column) -> Column:
    """The one-character class of a token; modifiers have none."""
    known = F.create_map(*[F.lit(x) for pair in WORD_CODES.items() for x in pair])
    first = F.substring(token, 1, 1)
    is_array = token.endswith("]")
    element = F.regexp_replace(token, r"(\[\])+$", "")
    return (
        F.when(token.isin(list(WORD_CODES)), F.element_at(known, token))
        .when(is_array & (first.between("A", "Z") | element.isin(PRIMITIVE_TYPES)), F.lit("y"))
        .when(is_array, F.lit("x"))
        .when(first.between("A", "Z"), F.lit("u"))
        .when(first.between("a", "z") | (first == "_"), F.lit("a"))
        .otherwise(F.lit("x"))
    )


def code_string(tokens: Column) -> Column:
    """All token codes of a document, after a mark for its beginning."""
    return F.concat(F.lit("^"), F.array_join(F.transform(tokens, token_code), ""))


# Rewrites of a code string, in order. ``!`` marks a statement that follows a block edge or a
# semicolon, ``?`` one that follows "else", ``~`` one that follows a closing parenthesis (valid
# only if that closed the head of an if, for or while). The letter after a mark is the kind.
EVENT_REWRITES = [
    (r"(?<=[qfw])\(", "["),  # parenthesis that opens a head
    (r"(?<=[=y,])\{", "<"),  # brace of an array initialiser
    (r"(k[^{}()\[;<]*)\{", "$1@"),  # brace of a class body
    (r"(?<=[{};@^])(?=[^{}@;)<hn])", "!"),
    (r"(?<=h)(?=[^{}@;)<hn])", "?"),
    (r"(?<=\))(?=[^{}@;)<hn])", "~"),
    (r"([!?~])t(?=\()", "$1z"),  # try with a head
    (r"([!?~])(?=[yu][au]\()", "$1m"),
    (r"([!?~])(?=[yu][au][=,;])", "$1v"),
    (r"([!?~])(?=[au]\()", "$1l"),
    (r"([!?~])(?=[^pikqfwrtzsjmvl])", "$1e"),
    (r"([!?~].)|[^(\[){}@<]", "$1"),  # keep marks, parentheses and braces
    (r"(?<![!?~])(?:\(\)){2,}+", "()"),  # several calls without a statement between them change no more than one
]


def event_string(codes: Column) -> Column:
    """Marked statement starts, parentheses and braces of a document, in order, from its code string."""
    return reduce(lambda s, rule: F.regexp_replace(s, *rule), EVENT_REWRITES, codes)


def _sum_of(flag: Column) -> Column:
    return F.sum(F.when(flag, 1).otherwise(0)).cast("bigint")


def structure_events(docs: DataFrame, doc_id: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per event with nesting depth; a document without events keeps one empty row.

    Adds ``kind`` (a letter, set where a statement starts), ``direct`` (it follows a block edge or
    a semicolon) and ``depth`` (open braces before the event). Expects ``tokens``, or ``codes`` in their place.
    """
    codes = F.col("codes") if "codes" in docs.columns else code_string(F.col("tokens"))
    strings = dealt(docs.select(doc_id, *carry, event_string(codes).alias("_events")), doc_id)
    events = F.posexplode_outer(F.regexp_extract_all("_events", F.lit(r"[!?~].|."), F.lit(0)))
    by_doc = strings.select(doc_id, *carry, events.alias("pos", "event"))
    event = F.col("event")
    in_order = Window.partitionBy(doc_id).orderBy("pos")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    paren_step = F.when(event.isin("(", "["), 1).when(event == ")", -1).otherwise(0)
    brace_step = F.when(event.isin("{", "@", "<"), 1).when(event == "}", -1).otherwise(0)
    nested = by_doc.withColumns(
        {
            "_parens": F.sum(paren_step).over(so_far) - paren_step,
            "depth": F.sum(brace_step).over(so_far) - brace_step,
        }
    )
    at_top = F.col("_parens") <= 0
    opens_head = F.last(F.when(at_top & event.isin("(", "["), event == "["), ignorenulls=True).over(so_far)
    letter = F.upper(F.substring(event, 2, 1))
    marked = event.rlike("^[!?]") | (event.startswith("~") & F.col("_head"))
    # Parentheses have done their part; a first row stays for documents that hold nothing else.
    useful = F.col("kind").isNotNull() | event.isin("{", "@", "<") | (F.coalesce("pos", F.lit(0)) == 0)
    return (
        nested.withColumn("_head", opens_head)
        .withColumn("_letter", F.when(at_top & marked, letter))
        .withColumn("kind", F.when(F.col("_letter") == "Z", "T").otherwise(F.col("_letter")))
        .withColumn("direct", F.col("kind").isNotNull() & event.startswith("!"))
        .withColumn(
            "piece",
            F.when(F.col("_letter").isin("Q", "F", "W", "Z"), F.concat("kind", F.lit("C")))
            .when(F.col("kind").isNotNull(), F.col("kind"))
            .when((event == "{") & at_top, F.lit("B")),
        )
        .filter(useful)
        .select(doc_id, *carry, "pos", "event", "kind", "direct", "depth", "piece")
    )


def statement_kinds(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per statement start: its ordinal in the document, kind and brace depth."""
    events = structure_events(docs, doc_id).filter(F.col("kind").isNotNull())
    ordinal = F.row_number().over(Window.partitionBy(doc_id).orderBy("pos"))
    return events.select(doc_id, ordinal.alias("stmt"), "kind", F.col("depth").cast("bigint").alias("depth"))


def token_context(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each token with its neighbours and the braces and parentheses open after it.

    Texts are placed by document before they are cut, which moves far less than their tokens.
    """
    placed = with_tokens(dealt(docs.select(doc_id, text), doc_id), text)
    stream = explode_with_position(placed, doc_id, "tokens", "token")
    in_order = Window.partitionBy(doc_id).orderBy("pos")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    token = F.col("token")
    return stream.select(
        doc_id,
        "pos",
        "token",
        F.lag("token").over(in_order).alias("prev"),
        F.lead("token").over(in_order).alias("next"),
        F.sum(F.when(token == "{", 1).when(token == "}", -1).otherwise(0)).over(so_far).alias("brace_depth"),
        F.sum(F.when(token == "(", 1).when(token == ")", -1).otherwise(0)).over(so_far).alias("paren_depth"),
    )


def doc_features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All per-document features and the kind sequence, with one shuffle by document."""
    return features_of_codes(counted_tokens(docs, doc_id, text=text, code=CODER).drop("bag"), doc_id)


def features_of_codes(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The same, from documents that have been cut and have ``num_tokens``, ``num_unique_tokens`` and ``codes``."""
    carry = ("num_tokens", "num_unique_tokens")
    events = structure_events(docs, doc_id, carry)
    kind = F.col("kind")
    in_order = Window.partitionBy(doc_id).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    method_depth = F.last(F.when(kind == "M", F.col("depth")), ignorenulls=True).over(in_order)
    in_body = F.col("direct") & kind.isin(list(BODY_KINDS)) & (F.col("depth") == F.col("_method_depth") + 1)
    pieces = F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", "piece"))))
    open_braces = F.when(F.col("event").isin("{", "@", "<"), F.col("depth") + 1).otherwise(0)
    counted = (
        events.withColumn("_method_depth", method_depth)
        .groupBy(doc_id)
        .agg(
            *[F.first(name).alias(name) for name in carry],
            F.max(open_braces).cast("bigint").alias("max_depth"),
            _sum_of(in_body).alias("_body"),
            F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("kinds"),
        )
    )
    # Every statement has its letter in the sequence, so counts are read off there.
    among = lambda letters: (F.length("kinds") - F.length(F.translate("kinds", letters, ""))).cast("bigint")
    named = counted.select(
        doc_id,
        *carry,
        *[among(letter).alias(name) for name, letter in COUNTED_KINDS.items()],
        among(STATEMENT_KINDS).alias("num_statements"),
        F.lit(0).cast("bigint").alias("num_var_declarations"),
        "max_depth",
        "_body",
        "kinds",
    )
    length = F.when(F.col("num_methods") > 0, F.col("_body") / F.col("num_methods")).otherwise(F.lit(0.0))
    return named.withColumn("avg_method_length", length).drop("_body")


def kind_sequence(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return doc_features(docs, doc_id, text).select(doc_id, "kinds")


def kind_ngrams(sequences: DataFrame, n: int, doc_id: str = "doc_id", kinds: str = "kinds") -> DataFrame:
    """Count of each run of ``n`` kinds per document, as kind names joined by ``_``.

    A sequence is cut into its runs inside the row; the count shuffles only partial sums.
    """
    letters = sequences.select(doc_id, F.split(kinds, "").alias("_letters")).withColumn("_n", F.size("_letters"))
    names = F.create_map(*[F.lit(x) for pair in KIND_NAMES.items() for x in pair])
    shifted = [F.slice("_letters", i + 1, 1 << 30) for i in range(n)]
    runs = reduce(lambda left, right: F.zip_with(left, right, lambda a, b: F.concat(a, b)), shifted)
    grams = explode_with_position(letters.withColumn("_runs", runs), doc_id, "_runs", "code").filter(
        F.col("code").isNotNull() & (F.length("code") == n)
    )
    named = F.array_join(F.transform(F.split("code", ""), lambda c: F.element_at(names, c)), "_")
    return (
        grams.groupBy(doc_id, "code")
        .agg(F.count("*").alias("cnt"))
        .select(doc_id, named.alias("gram"), "code", "cnt")
    )


def named_ngrams(sequences: DataFrame, doc_id: str = "doc_id", kinds: str = "kinds") -> DataFrame:
    """Counts of the named n-grams, one column each, computed inside the row.

    Occurrences may overlap, so each is counted where the rest of it follows.
    """

    def occurrences(code: str) -> Column:
        pattern = f"{code[0]}(?={code[1:]})"
        return F.regexp_count(kinds, F.lit(pattern)).cast("bigint")

    return sequences.select(doc_id, *[occurrences(code).alias(name) for name, code in NAMED_NGRAMS.items()])
