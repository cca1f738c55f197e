"""Lint of marketing copy: hollow words, mechanical phrases, emoji, missing numbers; and a cleaner."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F, types as T

from .rx import SPACES, all_matches, js, let, low, trimmed

# Pattern, rule and suggestion of each kind of violation.
PORTUGUESE = [
    (r"\b(no mundo din[aâ]mico de hoje|no cen[aá]rio atual|na era digital)\b", "Abertura clichê de IA (throat-clearing)", "Vá direto ao ponto ou ao fato concreto"),
    (r"\b(revolucion[aá]ri[ao]s?|divisor de [aá]guas|disruptiv[ao]s?)\b", "Hipérbole vazia sem dados comprobatórios", "Descreva o resultado específico em números ou tempo economizado"),
    (r"\b(elevar\s+(seu|o)\s+neg[oó]cio ao pr[oó]ximo (n[ií]vel|patamar))\b", "Chavão corporativo de IA", "Especifique o crescimento: 'aumentar o faturamento em X%' ou 'reduzir no-shows'"),
    (r"\b(desbloquear\s+(o\s+)?potencial|liberar\s+o\s+potencial)\b", "Metáfora de IA vazia ('unlock the potential')", "Explicite a ação técnica ou comercial real"),
    (r"\b(mergulhar\s+(fundo|em)|vamos\s+mergulhar)\b", "Tradução literal do vício em inglês ('delve into')", "Use 'analisar', 'verificar' ou entre direto no assunto"),
    (r"(?<![\p{L}\d])(vale\s+(a\s+pena\s+)?destacar(\s+que)?|[eé]\s+importante\s+(notar|ressaltar)\s+que)\b", "Sinalizador de transição desnecessário (filler)", "Elimine a introdução e declare o fato diretamente"),
    (r"\b(sinergia|ecossistema\s+inovador|solu[cç][aã]o\s+robusta|de\s+ponta)\b", "Jargão oco sem diferenciação técnica", "Explique como funciona o mecanismo ou cite uma funcionalidade real"),
    (r"\b(empoderar|empoderamento)\b", "Buzzword vago ('empower')", "Diga quem faz o que: 'permite que a recepcionista confirme' etc."),
    (r"\b(em\s+suma|em\s+conclus[aã]o|para\s+finalizar)\b", "Fechamento mecânico de redação escolar de IA", "Faça uma chamada para ação clara (CTA) ou encerre no dado final"),
    (r"\b(um\s+testemunho\s+d[eo]|um\s+verdadeiro\s+testemunho)\b", "Tradução do calque 'testament to'", "Use 'comprova que' ou 'mostra que'"),
    (r"\b(tape[cç]aria|mosaico\s+de)\b", "Metáfora artificial de IA ('tapestry')", "Use termos precisos como 'conjunto', 'histórico' ou 'rede'"),
]
ENGLISH = [
    (r"\b(in today['’]?s\s+(fast-paced|rapidly\s+evolving|digital)\s+(world|landscape|age))\b", "AI throat-clearing cliché", "Start immediately with the specific fact or problem"),
    (r"\b(delve(\s+into)?|delving)\b", "Classic ChatGPT signature vocabulary", "Use 'examine', 'inspect', or go directly to the topic"),
    (r"\b(game-changer|revolutionary|disruptive)\b", "Hollow hyperbolic assertion", "Provide concrete numbers, time saved, or dollar figures"),
    (r"\b(tapestry|beacon|testament to)\b", "Overused florid AI metaphors", "Use concrete nouns grounded in reality"),
    (r"\b(unlock(ing)?\s+(the\s+)?potential|elevate\s+your\s+business)\b", "Generic marketing fluff", "State the measurable outcome (e.g. 'gain 15 private patients/mo')"),
    (r"\b(it['’]?s\s+worth\s+noting(\s+that)?|it\s+is\s+important\s+to\s+remember)\b", "Filler signposting", "State the fact directly without preamble"),
    (r"\b(supercharge|harness\s+the\s+power\s+of)\b", "Vague power-word clichés", "Explain the mechanical benefit"),
    (r"\b(in\s+conclusion|furthermore|moreover)\b", "Mechanical academic transition words in commercial copy", "Keep sentences punchy and conversational"),
]
ANTITHESIS = [
    (r"\b(n[aã]o\s+(se\s+trata|é)\s+apenas\s+(de\s+)?.+?,\s*mas\s+(sim\s+)?(de\s+)?)", "Antítese mecânica ('Não é apenas X, mas sim Y')", "Declare a tese afirmativa diretamente sem o artifício retórico"),
    (r"\b(it['’]?s\s+not\s+just\s+about\s+.+?,\s*it['’]?s\s+about\s+)", "Mechanical antithesis ('It's not just about X, it's about Y')", "State what it is directly without contrasting it against a strawman"),
]
FORMATTING = ("Excesso de emojis decorativos (fingerprint de bot de IA)", "Limite os emojis a no máximo 1 por mensagem ou elimine-os para manter tom profissional")
HOLLOW = ("Falta de ancoragem em dados concretos (Lack of Grounding)", "Inclua métricas reais: avaliações Google, número de clientes, tempo de resposta ou valores")
HOLLOW_MATCH = "Texto sem dados numéricos ou evidências factuais"
NUMBERS = r"\b(\d+([.,]\d+)?%?|\$\d+|\d+\s*★|CRM[-\s]?[A-Z]{2}|\d{2,}\s*(minutos|dias|horas|anos|pacientes|clientes))\b"
EMOJI = r"[\x{1F300}-\x{1F6FF}\x{1F900}-\x{1F9FF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}]"
POINTS = {"banned_word": 25, "false_antithesis": 30, "formatting": 15, "hollow_claim": 20}
# What the cleaner drops or replaces, in this order.
REPLACED = [
    (r"^(no mundo din[aâ]mico de hoje|no cen[aá]rio atual|na era digital)[,.\s]*", ""),
    (r"^(in today['’]?s\s+(fast-paced|rapidly\s+evolving|digital)\s+(world|landscape|age))[,.\s]*", ""),
    (r"(?<![\p{L}\d])(vale\s+destacar\s+que|[eé]\s+importante\s+notar\s+que|it['’]?s\s+worth\s+noting\s+that)\s*", ""),
    (r"\b(revolucion[aá]ri[ao]s?|divisor de [aá]guas)\b", "eficiente"),
    (r"\b(delve into|mergulhar em)\b", "analisar"),
    (r"\b(elevar\s+(seu|o)\s+neg[oó]cio ao pr[oó]ximo\s+(n[ií]vel|patamar))\b", "aumentar seus resultados"),
]


def rules(language: str = "auto") -> list[tuple[str, str, str, str]]:
    """(pattern, category, rule, suggestion)"""
    words = (PORTUGUESE if language in ("pt", "auto") else []) + (ENGLISH if language in ("en", "auto") else [])
    return [(p, "banned_word", *why) for p, *why in words] + [(p, "false_antithesis", *why) for p, *why in ANTITHESIS]


def words_of(text: Column) -> Column:
    return F.size(F.filter(F.split(trimmed(text), f"[{SPACES}]+"), lambda w: w != ""))


def sentences_of(text: Column) -> Column:
    return F.greatest(F.lit(1), F.size(F.filter(F.split(text, "[.!?]+"), lambda s: F.length(trimmed(s)) > 5)))


def metrics(text: Column) -> Column:
    """Struct words, sentences, average: what lint() says of a text's measure, without its rules."""
    counted = let(F.coalesce(text, F.lit("")), lambda t: F.struct(words_of(t).alias("words"), sentences_of(t).alias("sentences")))
    return let(counted, _measured)


def _measured(c: Column) -> Column:
    n = lambda x: F.when(c["words"] == 0, 0).otherwise(x).cast("int")
    return F.struct(c["words"].cast("int").alias("words"), n(c["sentences"]).alias("sentences"), n(F.floor(c["words"] / c["sentences"] + 0.5)).alias("average"))


def lint(text: Column, language: str = "auto") -> Column:
    """Struct is_slop, score, violations, banned, antitheses, words, numbers, sentences, average, grounded.

    Each rule is one regular expression that runs once over the text in lower case.
    """
    counted = let(F.coalesce(text, F.lit("")), lambda t: let(F.lower(t), lambda v: _counts(t, v, language)))
    return let(counted, _judged)


def _counts(t: Column, lower: Column, language: str) -> Column:
    kinds = {"banned_word": F.lit(0), "false_antithesis": F.lit(0)}
    for p, kind, *_ in rules(language):
        kinds[kind] = kinds[kind] + F.size(all_matches(lower, low(p)))
    return F.struct(
        kinds["banned_word"].alias("banned"), kinds["false_antithesis"].alias("antitheses"), words_of(t).alias("words"), F.size(all_matches(lower, low(NUMBERS))).alias("numbers"),
        F.size(all_matches(t, EMOJI)).alias("emoji"), sentences_of(t).alias("sentences"),
    )


def _judged(c: Column) -> Column:
    words, numbers, banned, antitheses = c["words"], c["numbers"], c["banned"], c["antitheses"]
    blank = words == 0
    decorated = (words > 20) & (c["emoji"] > F.ceil(words / 25))
    hollow = (words > 80) & (numbers == 0)
    raw = banned * POINTS["banned_word"] + antitheses * POINTS["false_antithesis"] + decorated.cast("int") * POINTS["formatting"] + hollow.cast("int") * POINTS["hollow_claim"]
    points = F.least(F.lit(100), F.greatest(F.lit(0), raw - F.when(numbers > 0, F.least(F.lit(20), numbers * 5)).otherwise(0)))
    violations = banned + antitheses + decorated.cast("int") + hollow.cast("int")
    n = lambda x: F.when(blank, 0).otherwise(x).cast("int")
    return F.struct(
        (~blank & ((points >= 25) | (violations > 0))).alias("is_slop"), n(points).alias("score"), n(violations).alias("violations"), n(banned).alias("banned"), n(antitheses).alias("antitheses"),
        words.cast("int").alias("words"), n(numbers).alias("numbers"), n(c["sentences"]).alias("sentences"), n(F.floor(words / c["sentences"] + 0.5)).alias("average"), (~blank & (numbers > 0)).alias("grounded"),
    )


_PLACED = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("category", "matched", "rule", "suggestion")] + [T.StructField("index", T.IntegerType())]))


def _python(pattern: str) -> re.Pattern:
    """The rule for Python: ASCII word edges, Unicode white space and letters."""
    edge = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    code = lambda m: chr(int(m[1], 16))
    return re.compile(re.sub(r"\\x\{(\w+)\}", code, pattern).replace(r"\b", edge).replace(r"[\p{L}\d]", r"\w"), re.I)


def violations(language: str = "auto"):
    """A column function: every violation of lint() with its text, rule, suggestion and place, as Spark gives no offsets of all matches."""
    compiled = [(_python(p), *why) for p, *why in rules(language)]
    emoji, number = _python(EMOJI), _python(NUMBERS)

    def listed(t: str) -> list[dict]:
        out = [(kind, m[0], rule, suggestion, m.start()) for p, kind, rule, suggestion in compiled for m in p.finditer(t)]
        words, faces = len(t.split()), len(emoji.findall(t))
        if words > 20 and faces > -(-words // 25):
            out.append(("formatting", f"{faces} emojis em {words} palavras", *FORMATTING, 0))
        if words > 80 and not number.search(t):
            out.append(("hollow_claim", HOLLOW_MATCH, *HOLLOW, 0))
        return [dict(zip(("category", "matched", "rule", "suggestion", "index"), v)) for v in out]

    @F.pandas_udf(_PLACED)
    def found(texts):
        import pandas as pd

        return pd.Series([listed(t or "") for t in texts])

    return found


def sanitised(text: Column) -> Column:
    """Openings and signposts dropped, hollow words replaced."""
    for pattern, instead in REPLACED:
        text = F.regexp_replace(text, js(pattern, True), instead)
    return trimmed(text)
