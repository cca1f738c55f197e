"""Purchase intent of posts and comments by whole-word rules over accent-free text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .rx import EDGE, fold_accents, let, low


@dataclass(frozen=True)
class Lexicon:
    buyer: tuple
    question: tuple
    seller: tuple
    context: str | None = None
    exclude: str | None = None


# The rules of the verticals.
LEXICONS = {
    "generic": Lexicon(
        buyer=(
            r"\b(procuro|procurando|to buscando|estou buscando|estou procurando)\b",
            r"\b(quero|gostaria de|pretendo) (comprar|contratar|adquirir)\b",
            r"\bpreciso (de|contratar|comprar)\b",
            r"\balguem (vende|vendendo|indica|recomenda|conhece|faz)\b",
            r"\b(interesse em|orcamento para) (comprar|contratar)\b|\bcompro\b",
            r"\b(looking for|looking to (buy|hire)|in the market for|want to (buy|hire)|need (a|an|to buy|to hire))\b",
            r"\b(anyone|can anyone|can somebody) (recommend|know|selling|sell)\b|\brecommendations? for\b",
            r"\bwhere (can|do) i (buy|find|get)\b",
        ),
        question=(
            r"^\s*(valor|preco|quanto|price)\b",
            r"\b(qual o (valor|preco)|quanto (custa|sai|ta|esta)|manda o valor|passa o valor|me passa (o )?orcamento)\b",
            r"\b(how much|what('?s| is| does) .{0,20}(cost|price)|price\?)\b",
            r"\b(ainda )?(ta |esta )?disponivel\b|\bstill available\b",
            r"\b(tenho|have) interesse\b|\bi'?m interested\b",
            r"\b(me chama|chama no (privado|pv|zap|whats|direct|dm))\b|\b(dm me|message me|pm me)\b",
        ),
        seller=(
            r"\b(vendo|vende-se|vende se|a venda|for sale|selling)\b",
            r"\b(promocao|aproveite|desconto|oferta imperdivel|limited time|% off)\b",
            r"\b(nossos? (servicos|produtos)|trabalhamos com|we (offer|sell|provide)|book now|entre em contato)\b",
        ),
        exclude=r"\b(emprego|vagas?|estagio|curriculo|jobs?|hiring|resume|internship)\b",
    ),
    "car": Lexicon(
        buyer=(
            r"\b(procuro|procurando|to buscando|estou buscando)\b",
            r"\bquero (comprar|um carro|uma moto|um veiculo)\b",
            r"\bpreciso de um (carro|veiculo)\b",
            r"\balguem (vende|vendendo|tem .{0,30}pra vender|indica)\b",
            r"\bcompro\b",
            r"\binteresse em comprar\b",
            r"\bqual carro (comprar|compensa)\b",
        ),
        question=(
            r"^\s*(valor|preco|quanto)\b",
            r"\b(qual o valor|quanto (ta|esta|custa|sai)|manda o valor|passa o valor)\b",
            r"\b(ainda )?(ta |esta )?disponivel\b",
            r"\baceita (troca|proposta|carro)\b",
            r"\b(faz|aceita|tem) financiamento\b|\bfinancia\?",
            r"\b(qual a )?(entrada|parcela)\b.*\?",
            r"\btenho interesse\b",
            r"\b(me chama|chama no (privado|pv|zap|whats|direct|dm))\b",
        ),
        seller=(
            r"\b(vendo|vende-se|vende se|a venda)\b",
            r"\brepass(e|o)\b",
            r"\baceito (troca|proposta|cartao)\b",
            r"\bvalor:?\s*r?\$",
            r"\b(ipva pago|documento ok|abaixo da fipe)\b",
            r"\b(temos|tenho) em estoque\b|\bfinanciamos\b",
        ),
        context=r"\b(carro|veiculo|moto|suv|sedan|hatch|picape|pickup|caminhonete|seminovo|usado|0km|zero km|fipe|gol|onix|hb20|strada|toro|hilux|s10|ranger|corolla|civic|argo|mobi|kwid|polo|virtus|t-cross|nivus|compass|renegade|tracker|creta|kicks|sandero|logan|fiesta|ka|uno|palio|siena|saveiro|fiorino|spin|cobalt|prisma|celta|corsa|fox|up|voyage|etios|yaris|hr-v|hrv|fit|city|duster|oroch|208|2008|c3|cronos|pulse|fastback|montana)\b",
        exclude=r"\b(pecas?|pneus?|rodas?|som automotivo|mecanic[oa]s?|oficina|funilaria|lanternagem|seguro|guincho|despachante|emplacamento|lavagem|insulfilm|emprego|vaga)\b",
    ),
}
# Points of a lead, and how a budget is worded.
BASE = {"buyer": 75, "price_question": 50}
REGION_POINTS, BUDGET_POINTS = 15, 10
_BUDGET = low(r"\b(?:ate|up to|under|budget(?: of)?)\s*(r\$\s*|\$\s*)?(\d{1,3}(?:[.,]\d{3})*|\d+)\s*(mil|k)?\b")


def budget(folded: Column) -> Column:
    """Amount after `up to` and the like; years and amounts below 1000 don't count, unless in thousands."""
    return let(F.regexp_extract(folded, _BUDGET, 0), _amount)


def _amount(phrase: Column) -> Column:
    part = lambda k: F.regexp_extract(phrase, "^" + _BUDGET, k)
    n = F.regexp_replace(part(2), "[.,]", "").cast("double")
    year = n.between(1950, 2035) & (part(1) == "")
    return F.when(phrase != "", F.when(part(3) != "", n * 1000).when((n >= 1000) & ~year, n))


def region_of(folded: Column, regions: list[str]) -> Column:
    """The longest place name that stands as a whole word."""
    out = F.when(F.lit(False), "")
    import re
    import unicodedata

    plain = ["".join(c for c in unicodedata.normalize("NFD", r) if not unicodedata.combining(c)).lower() for r in regions]
    for r in sorted(plain, key=len, reverse=True):
        out = out.when(folded.contains(r) & folded.rlike(EDGE + re.escape(r) + EDGE), r)
    return out


def score(text: Column, vertical: str = "generic", regions: list[str] = ()) -> Column:
    """Struct kind, is_lead, score, matched, region, budget."""
    if vertical not in LEXICONS:
        raise ValueError(f"unknown vertical {vertical!r}; there are: {', '.join(LEXICONS)}")
    lex = LEXICONS[vertical]
    return let(let(fold_accents(F.coalesce(text, F.lit(""))), lambda t: _found(t, lex, list(regions))), _scored)


def _found(t: Column, lex: Lexicon, regions: list[str]) -> Column:
    """What each rule finds in folded text: one regular expression a rule, run once."""
    hits = lambda rules: F.filter(F.array(*[F.regexp_extract(t, low(r), 0) for r in rules]), lambda m: m != "")
    has = lambda rule, none: F.lit(none) if rule is None else t.rlike(low(rule))
    return F.struct(
        hits(lex.buyer).alias("buyer"), hits(lex.question).alias("question"), hits(lex.seller).alias("seller"), budget(t).alias("budget"), region_of(t, regions).alias("region"),
        has(lex.context, True).alias("context"), has(lex.exclude, False).alias("excluded"),
    )


def _scored(f: Column) -> Column:
    buys = (F.size(f["buyer"]) > 0) & (f["context"] | f["budget"].isNotNull()) & ~f["excluded"]
    kind = F.when(buys, "buyer").when(F.size(f["seller"]) > 0, "seller").when(F.size(f["question"]) > 0, "price_question").otherwise("none")
    return let(kind, lambda k: _pointed(f, k))


def _pointed(f: Column, kind: Column) -> Column:
    lead = kind.isin(*BASE)
    base = F.when(kind == "buyer", BASE["buyer"]).otherwise(BASE["price_question"])
    points = F.least(F.lit(100), base + F.when(f["region"].isNotNull(), REGION_POINTS).otherwise(0) + F.when(f["budget"] > 0, BUDGET_POINTS).otherwise(0))
    return F.struct(kind.alias("kind"), lead.alias("is_lead"), F.when(lead, points).otherwise(0).alias("score"), F.concat(f["buyer"], f["question"], f["seller"]).alias("matched"), f["region"].alias("region"), f["budget"].alias("budget"))


def leads(items: DataFrame, vertical: str = "generic", regions: list[str] = (), all_items: bool = False) -> DataFrame:
    """Posts (item_id, author, text, url, comments: array of struct author, text, url) and their comments, best first.

    A comment without a URL has its post's. Ties keep the order of posts, each before its comments.
    """
    posts = items.select("item_id", F.lit(-1).alias("place"), "author", "text", "url")
    below = items.select("item_id", F.col("url").alias("post_url"), F.posexplode("comments").alias("place", "c")).select("item_id", "place", F.col("c.author").alias("author"), F.col("c.text").alias("text"), F.coalesce(F.nullif(F.col("c.url"), F.lit("")), "post_url").alias("url"))
    scored = posts.unionByName(below).withColumn("intent", score(F.col("text"), vertical, regions))
    kept = scored if all_items else scored.where("intent.is_lead")
    return kept.orderBy(F.col("intent.score").desc(), "item_id", "place")
