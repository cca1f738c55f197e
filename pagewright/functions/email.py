"""Email addresses: scan, clean, classify, undo spellings that hide them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .rx import EDGE, all_matches, js, let, trimmed

SCAN = rf"(?<![\w.%+-])[\w.%+-]{{1,64}}@[A-Za-z0-9-]{{1,63}}(?:\.[A-Za-z0-9-]{{1,63}})*\.[A-Za-z]{{2,24}}{EDGE}"

# Names that stand for no one, domains and file endings that are no addresses, names of roles, and kinds of providers.
PLACEHOLDER_LOCALS = [
    "user", "usuario", "example", "exemplo", "test", "teste", "email", "e-mail", "seuemail", "seu-email", "seu.email", "seunome", "nome", "fulano",
    "yourname", "your-email", "youremail", "name", "johndoe", "john.doe", "foo", "bar",
]
IGNORED_DOMAINS = [
    "example.com", "example.org", "example.net", "exemplo.com", "exemplo.com.br", "domain.com", "dominio.com", "dominio.com.br", "seudominio.com",
    "seudominio.com.br", "yourdomain.com", "mydomain.com", "site.com", "seusite.com", "seusite.com.br", "email.com", "sentry.io", "wixpress.com",
    "cloudflare.com", "schema.org", "wordpress.org", "gravatar.com", "w3.org", "sentry-next.wixpress.com",
]
FILE_ENDINGS = [
    "png", "jpg", "jpeg", "webp", "avif", "gif", "bmp", "svg", "tif", "tiff", "heic", "ico", "css", "js", "mjs", "json", "map", "woff", "woff2",
    "ttf", "otf", "eot", "pdf", "mp4", "webm", "php",
]
ROLES = [
    "contato", "contatos", "faleconosco", "fale-conosco", "fale.conosco", "vendas", "venda", "financeiro", "atendimento", "comercial", "sac", "rh",
    "suporte", "orcamento", "orcamentos", "agendamento", "agendamentos", "recepcao", "secretaria", "administrativo", "adm", "admin", "diretoria",
    "compras", "cobranca", "faturamento", "fiscal", "contabilidade", "juridico", "marketing", "imprensa", "ouvidoria", "pedidos", "loja", "clinica",
    "escritorio", "geral", "noreply", "no-reply", "naoresponda", "nao-responda", "trabalheconosco", "curriculos", "curriculo", "parcerias", "eventos",
    "reservas", "empresa", "info", "contact", "contacts", "sales", "support", "help", "hello", "hi", "office", "billing", "accounts", "hr", "jobs",
    "careers", "press", "media", "team", "service", "services", "customerservice", "webmaster", "postmaster", "hostmaster", "abuse", "privacy",
    "legal", "booking", "orders", "enquiries", "inquiries",
]
FREE_PROVIDERS = [
    "gmail.com", "googlemail.com", "hotmail.com", "hotmail.com.br", "outlook.com", "outlook.com.br", "live.com", "msn.com", "yahoo.com",
    "yahoo.com.br", "ymail.com", "icloud.com", "me.com", "mac.com", "uol.com.br", "bol.com.br", "terra.com.br", "ig.com.br", "globo.com",
    "globomail.com", "r7.com", "zipmail.com.br", "protonmail.com", "proton.me", "aol.com", "gmx.com", "zoho.com",
]
DISPOSABLE = [
    "mailinator.com", "guerrillamail.com", "10minutemail.com", "tempmail.com", "temp-mail.org", "yopmail.com", "trashmail.com", "sharklasers.com",
    "getnada.com", "dispostable.com", "maildrop.cc", "throwawaymail.com", "fakeinbox.com", "mintemail.com", "emailondeck.com",
]
_AT = js(r"\s{0,3}[\[({<]\s{0,3}(?:at|arroba)\s{0,3}[\])}>]\s{0,3}", True)
_DOT = js(r"\s{0,3}[\[({<]\s{0,3}(?:dot|ponto)\s{0,3}[\])}>]\s{0,3}", True)
_SPACED = js(r"(?<=\w)\s{1,3}@\s{1,3}(?=[A-Za-z0-9])")


def scan(text: Column) -> Column:
    return all_matches(text, SCAN)


def domain_of(email: Column) -> Column:
    return F.substring_index(email, "@", -1)


def in_domains(domain: Column, domains: list[str]) -> Column:
    """The domain is one of them or below one."""
    alternatives = "|".join(d.replace(".", r"\.") for d in domains)
    return domain.rlike(rf"(?:^|\.)(?:{alternatives})$")


def clean(raw: Column) -> Column:
    """The address in lower case, null for placeholders, file names, vendors' domains, hashes and broken ones."""
    v = F.substring_index(F.regexp_replace(trimmed(raw), "^(?i)mailto:", ""), "?", 1)
    v = F.coalesce(F.try_url_decode(F.replace(v, F.lit("+"), F.lit("%2B"))), v)  # a bad escape leaves it as it is
    return let(F.regexp_replace(F.lower(trimmed(v)), js(r"""^[<("'\s]+|[>)"'.,;:\s]+$"""), ""), _checked)


def _checked(v: Column) -> Column:
    local, domain = F.substring_index(v, "@", 1), domain_of(v)
    good = (
        F.length(v).between(6, 100)
        & (F.length(v) - F.length(F.replace(v, F.lit("@"), F.lit(""))) == 1)
        & local.rlike(r"^[\w.%+-]{1,64}$")
        & ~local.rlike(r"^\.|\.$|\.\.")
        & domain.rlike(r"^[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63})*\.[a-z]{2,24}$")
        & ~domain.rlike(r"(?:^|\.)-|-(?:\.|$)")
        & ~domain.rlike(r"^\d+(?:\.\d+)?x\.")
        & ~F.substring_index(domain, ".", -1).isin(FILE_ENDINGS)
        & ~local.isin(PLACEHOLDER_LOCALS)
        & ~in_domains(domain, IGNORED_DOMAINS)
        & ~local.rlike(r"^[0-9a-f]{20,}$")
    )
    return F.when(good, v)


def clean_all(raws: Column) -> Column:
    """Distinct clean addresses of an array, in its order."""
    return F.array_distinct(F.filter(F.transform(raws, clean), lambda x: x.isNotNull()))


def kind(email: Column) -> Column:
    local = F.lower(F.substring_index(email, "@", 1))
    head = F.regexp_extract(local, r"^[^.\-_+0-9]*", 0)
    return F.when(local.isin(ROLES) | head.isin(ROLES), "role").otherwise("personal")


def analyse(email: Column, host: Column | None = None) -> Column:
    domain = F.lower(domain_of(email))
    site = None if host is None else F.regexp_replace(F.lower(host), r"^www\.", "")
    matches = F.lit(None).cast("boolean") if site is None else (domain == site) | domain.endswith(F.concat(F.lit("."), site)) | site.endswith(F.concat(F.lit("."), domain))
    return F.struct(email.alias("email"), kind(email).alias("kind"), domain.alias("domain"), domain.isin(FREE_PROVIDERS).alias("free_provider"), in_domains(domain, DISPOSABLE).alias("disposable"), matches.alias("matches_site"))


def deobfuscate(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, _AT, "@"), _DOT, "."), _SPACED, "@")


def find(text: Column) -> Column:
    """Clean addresses of free text: plain ones first, then those that were spelled out."""
    return clean_all(F.concat(scan(text), scan(deobfuscate(text))))


def decode_protected(hex_text: Column) -> Column:
    """Address behind a protected link: hex bytes, each XORed with the first."""
    key = F.conv(F.substring(hex_text, 1, 2), 16, 10).cast("int")
    places = F.sequence(F.lit(3), F.length(hex_text) - 1, F.lit(2))
    one = F.transform(places, lambda i: F.char(F.conv(F.substr(hex_text, i, F.lit(2)), 16, 10).cast("int").bitwiseXOR(key)))
    return F.when(hex_text.rlike("^(?:[0-9a-fA-F]{2}){2,}$"), F.array_join(one, ""))


def with_mx(emails, mx_records, now: Column, ttl_hours: int = 6):
    """Adds mx_ok: true or false by a record of the last hours, null where none says. mx_records: domain, exchange, checked_at."""
    fresh = mx_records.where(F.col("checked_at") > now - F.expr(f"interval {ttl_hours} hours"))
    known = fresh.groupBy("domain").agg(F.max((F.col("exchange").isNotNull() & ~F.col("exchange").isin("", "."))).alias("mx_ok"))
    return emails.withColumn("domain", domain_of(F.col("email"))).join(known, "domain", "left")
