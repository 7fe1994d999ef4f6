"""Text measures as column expressions: quality, tags, lattice, routing, mode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Signals and limits that results depend on.
CODE_KEYWORDS = ["def ", "class ", "import ", "return ", "SELECT ", "{", "};"]
ROLE_HINTS = {"textbook": 1, "educational": 1, "code": 2, "programming": 2, "reasoning": 3, "math": 3, "tool": 4, "api": 4, "qa": 5, "dialogue": 5}
ROLE_CODE_SIGNALS = ["def ", "class ", "import ", "function ", "return ", "const ", "var ", "pub fn "]
ROLE_MATH_SIGNALS = ["theorem", "proof", "equation", "=", "∀", "∃", "therefore", "hence"]
ROLE_QA_SIGNALS = ["question:", "answer:", "q:", "a:", "user:", "assistant:"]
ROUTE_CODE = r"(def |class |import |from |function |return |const |var |pub fn |async fn |=>|\{|\})"
ROUTE_MATH = r"(?i)(theorem|proof|lemma|equation|therefore|hence|Q\.E\.D)"
ROUTE_QA = r"(?im)(^Q:|^A:|^Question:|^Answer:|^User:|^Assistant:|^Human:)"
TEXTBOOK_WORDS = ["textbook", "chapter", "section", "abstract", "introduction"]
MODE_CODE = ["def ", "class ", "import ", "return ", "{", "};", "```"]
MODE_ASK = ["who", "what", "when", "where", "why", "how"]
MODE_LOGIC = ["therefore", "because", "premise", "conclusion"]

BLANK = r"[\s\x1c-\x1f\x85   -     　]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+\z", "")


def hits(text: Column, signals: list[str]) -> Column:
    """How many of the signals occur at least once."""
    return sum((F.when(text.contains(s), 1).otherwise(0) for s in signals), F.lit(0))


def word_tokens(text: Column) -> Column:
    """Unicode word tokens of the lower-case text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1))


def quality(text: Column, loss_before: Column | None = None, loss_after: Column | None = None) -> Column:
    """struct of the six signals, each rounded to six places, and the score; weights .28 .26 .18 .18 .16 -.08."""
    gain = F.lit(0.0) if loss_before is None or loss_after is None else F.coalesce(F.greatest(F.least(loss_before - loss_after, F.lit(1.0)), F.lit(-1.0)), F.lit(0.0))

    def measured(p: Column) -> Column:
        n, distinct, size = p["n"].cast("double"), p["u"].cast("double"), p["size"]
        diversity = F.when(p["n"] > 0, distinct / n).otherwise(0.0)
        lines = F.least(p["lines"] / F.lit(8.0), F.lit(1.0))
        code = F.least(p["code"] / F.lit(4.0), F.lit(1.0))
        return F.struct(
            F.round(F.least(n / 128.0, F.lit(1.0)), 6).alias("length_signal"),
            F.round(diversity, 6).alias("diversity"),
            F.round(1.0 - F.least(F.greatest(1.0 - diversity, F.lit(0.0)), F.lit(0.75)), 6).alias("repetition"),
            F.round(F.least(lines + code, F.lit(1.0)), 6).alias("structure"),
            F.round(F.least(p["brackets"].cast("double") / F.greatest(size, F.lit(1)), F.lit(0.3)), 6).alias("punctuation"),
            F.round(gain, 6).alias("improvement"),
        )

    def scored(s: Column) -> Column:
        raw = 0.28 * s["length_signal"] + 0.26 * s["diversity"] + 0.18 * s["repetition"] + 0.18 * s["structure"] + 0.16 * s["improvement"] - 0.08 * s["punctuation"]
        names = ["length_signal", "diversity", "repetition", "structure", "punctuation", "improvement"]
        return F.struct(*[s[c].alias(c) for c in names], F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 6).alias("quality_score"))

    def parts(t: Column) -> Column:
        return let(
            word_tokens(t),
            lambda w: F.struct(
                F.size(w).alias("n"),
                F.size(F.array_distinct(w)).alias("u"),
                F.length(t).alias("size"),
                (F.length(t) - F.length(F.translate(t, "\n", ""))).cast("double").alias("lines"),
                (F.length(t) - F.length(F.translate(t, "{}[]<>", ""))).alias("brackets"),
                hits(t, CODE_KEYWORDS).cast("double").alias("code"),
            ),
        )

    return let(let(let(strip(text), parts), measured), scored)


def role(text: Column, hint: Column | None = None) -> Column:
    low = F.lower(F.substring(text, 1, 2000))
    found = let(
        low,
        lambda s: F.when(hits(s, ROLE_CODE_SIGNALS) >= 3, 2).when(hits(s, ROLE_MATH_SIGNALS) >= 2, 3).when(hits(s, ROLE_QA_SIGNALS) >= 2, 5).otherwise(1),
    )
    if hint is None:
        return found
    key = F.lower(F.trim(hint))
    return F.coalesce(*[F.when(key == k, v) for k, v in ROLE_HINTS.items()], found)


def topic_byte(text: Column) -> Column:
    """First byte of the sha256 of the first 512 characters."""
    return F.conv(F.substring(F.sha2(F.substring(text, 1, 512), 256), 1, 2), 16, 10).cast("int")


def color_parts(text: Column, hint: Column | None = None, token_count: Column | None = None) -> Column:
    """struct(hierarchy, r, g, b): role, topic, complexity and length bytes."""

    def made(p: Column) -> Column:
        n = p["n"]
        norm = F.least(F.lit(1.0), p["chars"].cast("double") / n / 12.0)
        complexity = F.when(n == 0, 0).otherwise(((0.5 * norm + 0.5 * (p["u"] / n)) * 255.0).cast("int"))
        tokens = (n * F.lit(1.3)).cast("long") if token_count is None else token_count
        length = F.when(tokens <= 0, 0).otherwise(F.least(F.lit(255), (F.log2(F.greatest(tokens, F.lit(1)).cast("double")) * 16).cast("int")))
        return F.struct(role(text, hint).alias("hierarchy"), topic_byte(text).alias("r"), F.greatest(F.lit(0), F.least(F.lit(255), complexity)).alias("g"), length.alias("b"))

    words = F.regexp_extract_all(text, F.lit("[a-zA-Z0-9]+"), F.lit(0))
    facts = let(
        words,
        lambda w: F.struct(
            F.size(w).alias("n"), F.size(F.array_distinct(F.transform(w, lambda x: F.lower(x)))).alias("u"), F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)).alias("chars")
        ),
    )
    return let(facts, made)


def pack_color(c: Column) -> Column:
    wide = lambda part, bits: F.shiftleft(c[part].cast("long").bitwiseAND(255), bits)
    return wide("hierarchy", 24).bitwiseOR(wide("r", 16)).bitwiseOR(wide("g", 8)).bitwiseOR(wide("b", 0))


def unpack_color(bits: Column) -> Column:
    part = lambda shift: F.shiftright(bits, shift).bitwiseAND(255).cast("int")
    return F.struct(part(24).alias("hierarchy"), part(16).alias("r"), part(8).alias("g"), part(0).alias("b"))


def color_distance(a: Column, b: Column) -> Column:
    square = lambda k: (a[k] - b[k]) * (a[k] - b[k])
    return F.when(a["hierarchy"] == b["hierarchy"], 0).otherwise(1024) + square("r") + square("g") + square("b")


def hue(c: Column) -> Column:
    """HSL hue in degrees, [0, 360)."""
    unit = F.struct(*[(c[k] / F.lit(255.0)).alias(k) for k in "rgb"])

    def turned(u: Column) -> Column:
        top, low = F.greatest(u["r"], u["g"], u["b"]), F.least(u["r"], u["g"], u["b"])
        delta = top - low
        angle = (
            F.when(top == u["r"], 60.0 * F.pmod((u["g"] - u["b"]) / delta, F.lit(6.0)))
            .when(top == u["g"], 60.0 * ((u["b"] - u["r"]) / delta + 2.0))
            .otherwise(60.0 * ((u["r"] - u["g"]) / delta + 4.0))
        )
        return F.when(delta == 0, 0.0).otherwise(F.when(angle < 0, angle + 360.0).otherwise(angle))

    return let(unit, turned)


def _clamp(x: Column, most: int = 1000) -> Column:
    return F.greatest(F.lit(-most), F.least(F.lit(most), x))


def lattice(text: Column, layer: int = 0) -> Column:
    """struct(x, y, z, layer): topic (floored), complexity and density (truncated)."""
    topic = F.conv(F.substring(F.sha2(F.substring(text, 1, 512), 256), 1, 4), 16, 10).cast("int") - 32768
    words = F.filter(F.split(text, rf"{BLANK}+", -1), lambda w: w != "")

    def made(p: Column) -> Column:
        n = F.greatest(p["n"], F.lit(1))
        richness = (p["u"] / n) * F.least(F.lit(1.0), p["chars"] / n / 10.0)
        density = (n * F.lit(1.3)).cast("long") / F.greatest(F.length(text), F.lit(1))
        return F.struct(
            _clamp(F.floor(topic / F.lit(33.0)).cast("int")).alias("x"),
            _clamp((richness * 2000 - 1000).cast("int")).alias("y"),
            _clamp(((density - 0.3) * 5000).cast("int")).alias("z"),
            F.lit(layer).alias("layer"),
        )

    facts = let(
        words,
        lambda w: F.struct(
            F.size(w).alias("n"), F.size(F.array_distinct(F.transform(w, lambda x: F.lower(x)))).alias("u"), F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)).alias("chars")
        ),
    )
    return let(facts, made)


def lattice_packed(p: Column) -> Column:
    """One integer whose order keeps near points together: layer, then x, y and z, 16 bits each."""
    part = lambda k, bits: F.shiftleft((p[k] + 32768).cast("long"), bits)
    return F.shiftleft(p["layer"].cast("long"), 48) + part("x", 32) + part("y", 16) + part("z", 0)


def lattice_distance(a: Column, b: Column) -> Column:
    apart = lambda k: F.abs(a[k] - b[k])
    return apart("x") + apart("y") + apart("z") + F.when(a["layer"] == b["layer"], 0).otherwise(256)


def route(text: Column, default_stride: int = 512) -> Column:
    """struct(pipeline, stride, chunk_boundary, confidence) from signal density in the first 3,000 characters."""
    sample = F.substring(text, 1, 3000)

    def decide(p: Column) -> Column:
        best = F.greatest(p["code"], p["reasoning"], p["qa"])
        pick = lambda name, stride, boundary, sure: F.struct(
            F.lit(name).alias("pipeline"), F.lit(stride).alias("stride"), F.lit(boundary).alias("chunk_boundary"), sure.alias("confidence")
        )
        sure = F.round(F.least(F.lit(1.0), best / 5.0), 6)
        return (
            F.when((best > 0.5) & (p["code"] == best), pick("code", 256, "function_boundary", sure))
            .when((best > 0.5) & (p["reasoning"] == best), pick("reasoning", 384, "proof_step", sure))
            .when(best > 0.5, pick("qa", 256, "turn_boundary", sure))
            .when(hits(F.lower(p["s"]), TEXTBOOK_WORDS) > 0, pick("textbook", 512, "sentence_boundary", F.lit(0.6)))
            .otherwise(pick("generic", default_stride, "fixed_stride", F.lit(0.3)))
        )

    rate = lambda s, pattern: F.regexp_count(s, F.lit(pattern)) / F.greatest(F.length(s), F.lit(1)) * 1000
    scores = let(sample, lambda s: F.struct(s.alias("s"), rate(s, ROUTE_CODE).alias("code"), rate(s, ROUTE_MATH).alias("reasoning"), rate(s, ROUTE_QA).alias("qa")))
    return let(scores, decide)


def mode(text: Column) -> Column:
    def decide(t: Column) -> Column:
        starts = F.lit(False)
        for word in MODE_ASK:
            starts = starts | t.startswith(word)
        return F.when(hits(t, MODE_CODE) > 0, "code").when(t.endswith("?") | starts, "qa").when(hits(t, MODE_LOGIC) > 0, "logic").otherwise("narrative")

    return let(F.lower(strip(text)), decide)
