"""Personal details in free text: found, and replaced by placeholders that name their type.

Generators with high recall propose spans that may overlap; each span becomes a row of numbers about its own format and
about what stands around it; boosted trees give its probability; spans over their type's threshold are taken, outer
before inner and likelier before others. The trees are fitted on sentences made here from frames and formats, a bounded
table of known labels; no text of the corpus is needed for it. A quarter of the frames is held out of the trees: on them
the probabilities are calibrated and the threshold of each type is chosen.
"""

from __future__ import annotations

import re
from bisect import bisect
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.functions import pandas_udf

from .common import table
from .trees import Boosted, calibrated, fit_boosted

TYPES = ("email", "phone", "id_number", "address", "name")
#: Sentences the model is fitted on; every so many-th frame is held out for calibration; bounds of a threshold.
TRAINING_SENTENCES, HELD_OUT, LOWEST, HIGHEST = 9_000, 4, 0.2, 0.8
#: Characters before and behind a span that its features look at; a longer line changes nothing.
BEFORE, AFTER = 60, 40

_AT, _DOT = r"(?:\s?(?:@|\[at\]|\(at\)|＠)\s?|\sat\s)", r"(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\sdot\s)"
_EMAIL = re.compile(rf"(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]*{_AT}[A-Za-z0-9][A-Za-z0-9-]*(?:{_DOT}[A-Za-z0-9-]+)+", re.I)
_PHONE = re.compile(r"(?<![\w.@/-])(?:\+|\(|(?=\d))\(?\d{1,5}\)?(?:[ ./-]?\(?\d{1,6}\)?){0,7}(?![\w@])")
_ID = re.compile(r"(?<![\w.@/+-])(?:(?:[A-Z]{1,2}[ -]?)?\d[\dA-Z]*(?:[ .-]?(?:\d[\dA-Z]*|[A-Z](?![A-Za-z])))*)(?![\w@])")
_NUMBER_LINE = r"\d{1,4}\s?[a-zA-Z]?"
_UNIT = r"(?:Apt|Apartment|Suite|Unit|Flat|Apto|piso|Bât)\.?\s?\w{1,5}"
_CAP = r"[A-ZÀ-ÞŒ][\w’'ß.-]*"
_WAY = r"(?:Close|Lane|Street|Road|Row|Avenue|Way|Drive|Hill|Court|Place|Terrace|Square|Crescent|Walk|Gardens|Mews|Boulevard|Quay|Green|Rise|Yard|Gate|Alley|Parade|Wharf|St|Rd|Ave|Ln|Dr|Blvd)"
# Addresses by what opens them: a number, a label, or a word with the number behind it.
_ADDRESS = (
    (re.compile(rf"(?<![\w.,/-]){_NUMBER_LINE},?\s(?=[A-ZÀ-ÞŒrabpcqi])"), re.compile(
        rf"(?<![\w.,/-]){_NUMBER_LINE},?\s(?:{_CAP}\s){{1,3}}{_WAY}\b\.?(?:\s{_UNIT})?"
        rf"|(?<![\w.,/-]){_NUMBER_LINE},?\s(?:bis\s)?(?:rue|avenue|boulevard|place|chemin|quai|impasse|allée)\s(?:(?:de la|de l[’']|des|du|de|d[’'])\s?)?{_CAP}"
    )),
    (re.compile(r"Flat|Unit|Apt|Suite|PO Box|P\.O\. Box|Postfach|Apartado|BP|Casella"), re.compile(
        rf"(?:Flat|Unit|Apt|Suite)\s\w{{1,4}},\s{_NUMBER_LINE}\s(?:{_CAP}\s){{1,3}}{_WAY}\b|(?:PO Box|P\.O\. Box|Postfach|Apartado|BP|Casella)\s\d{{1,6}},\s{_CAP}"
    )),
    (re.compile(r"(?<!\w)(?:Calle|Avenida|Avda\.|Plaza|Paseo|Camino|Rua|Travessa|Largo|Praça|C/|Am|Im|An|Auf|Zum|Zur|In|Unter|Hinter)\s"), re.compile(
        rf"(?:Calle|Avenida|Avda\.|Plaza|Paseo|Camino|Rua|Travessa|Largo|Praça|C/)\s(?:(?:del|de la|de los|de las|de|do|da|dos|das)\s)?{_CAP}(?:\s{_CAP})?,?\s(?:n\.?º\s?)?{_NUMBER_LINE}"
        rf"|(?:Am|Im|An de[rmn]|Auf de[rmn]|Zum|Zur|In de[rn]|Unter de[rn]|Hinter de[rmn])\s{_CAP}\s{_NUMBER_LINE}(?=,\s\d{{4,5}}\s)"
    )),
    (re.compile(r"(?<!\w)[A-ZÀ-ÞŒ]\w*(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring|steig|stieg)\s(?=\d)"), re.compile(rf"{_CAP}(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring|steig|stieg)\s{_NUMBER_LINE}")),
    (re.compile(r"〒?\d{3}-\d{4}|[가-힣]+(?:[시도]\s|[로길]\s)"), re.compile(r"〒?\d{3}-\d{4}\s?[一-龥ぁ-んァ-ン]+[\d丁目番地号-]+|[가-힣]+(?:시|도)\s[가-힣]+(?:구|군|시)\s[가-힣0-9]+(?:로|길|동)\s?\d+[\d-]*|[가-힣]+(?:로|길)\s\d{1,4}(?:-\d+)?(?=[,\s])")),
)


def addresses(text: str) -> list[tuple[int, int]]:
    """Spans that may be addresses; each way to write one is tried only where its opening stands."""
    out = []
    for opening, whole in _ADDRESS:
        at = 0
        for m in opening.finditer(text):
            if m.start() >= at and (got := whole.match(text, m.start())):
                at = got.end()
                out.append((m.start(), at))
    return out


_PLACE = re.compile(rf"(?:,\s\d{{1,2}}º\s\w)?,\s(?:\d{{4,5}}\s)?{_CAP}(?:[\s]{_CAP}){{0,3}}(?:\s[A-Z]\d{{1,2}}\b(?:\s\d[A-Z]{{2}})?)?(?:,\s[A-Z]{{2}}\s\d{{5}})?")
_NAMEWORD = r"(?:[A-ZÀ-ÞŒ][a-zà-ÿœ’'-]+(?:-[A-ZÀ-Þ][a-zà-ÿ]+)?)"
_PARTICLE = r"(?:van der|van den|van|von|zu|de la|de los|del|de|da|dos|di|du|le|la|bin|al)"
# Names overlap: every capital word may open one.
_NAME = re.compile(rf"(?<![\w@.’'+-])(?=([A-ZÀ-Þ]{{3,}},\s{_NAMEWORD}(?:\s[A-Z]\.)?|{_NAMEWORD}(?:\s[A-Z]\.){{0,2}}\s(?:{_PARTICLE}\s)?{_NAMEWORD}|(?:[A-Z]\.\s?){{1,2}}{_NAMEWORD})(?![\w@’']))")
_THIRD = re.compile(rf"\s{_NAMEWORD}(?![\w@’'])")
_NAME_EAST = re.compile(r"[가-힣]{2,4}(?=\s?(?:씨|님)(?:께서|[이가는은를을께의도와과에])?(?![가-힣]))|[一-龥々]{2,4}(?:\s[一-龥々ぁ-んァ-ン]{1,4})?(?=\s?(?:さん|様|氏)(?![一-龥]))|(?<=[:：]\s)(?:[가-힣]{2,4}|[一-龥々]{2,3}\s?[一-龥々]{1,3})(?=$|[\n,、(（;/|])")

# Words that stand before, or behind, what they name; lower case.
NEAR = {
    "mail": "mail e-mail email mailto reach write contact escriba escreva écrivez user login account unter cc reply 連絡先 연락처 メール 이메일 connexion".split(),
    "tool": "git install clone npm pip asset package icon image src version docker ssh scp pull push branch commit open".split(),
    "phone": "phone tel call text fax mobile ring dial telefon tél telefono teléfono telefone llame ligue appelez ruf rufen 電話 전화 連絡先 연락처 whatsapp sms cell".split(),
    "number": "ticket order build version range request timestamp invoice rev revision release issue case tracking serial port host code commit sha isbn sku batch sample reference ref reserved listens pid ip job event part error balance bestellung auftrag rechnung commande facture pedido encomenda 주문 注文".split(),
    "identity": "id identity passport ssn nie nif dni insurance social national ausweis personalausweis pasaporte passeport passaporte identité identidad identidade id-number ausweisnummer sociale sécurité sécu sozialversicherung n.º 주민등록번호는 주민등록번호 주민번호 tax steuer nir bi cpf rrn identification 身分証 マイナンバー licence license documento".split(),
    "person": "colleague according assigned thanks thank cc name regards sincerely signed author contact ask asked mr mrs ms dr herr frau monsieur madame señor señora sr sra senhor senhora by merci gracias danke obrigado obrigada 担当 담당자 作成者 작성자 escriba escreva écrivez demandez hable fale melden wenden dear hello hi saludos grüße grüßen cordialement wrote told said says sent reported reviewed reviewer reporter customer owner manager laut selon según segundo".split(),
    "home": "live lives living visit shipped address adresse anschrift morada endereço dirección domicilio habite réside vivo resido moro wohne wohnt lautet at ship deliver delivered post moved send sent come 住所 주소".split(),
    "thing": "chapters chapter section sections see version the der die das les la le el los las o a os as when where which outside entry of in to near from title page click read".split(),
    "speech": "says said say told tells tell wrote writes asked asks thinks thought agrees agreed disagrees objects doubts called calls sent replied replies answered explained explains mentioned suggested suggests confirmed knows noticed believes claims argues wants sagt sagte schrieb fragt meint findet dit écrit pense demande dice dijo escribió piensa diz disse escreveu pensa acha".split(),
    "role": "boss chief head manager director editor author teacher professor doctor nurse lawyer mayor coach neighbour neighbor friend brother sister uncle aunt mother father son daughter husband wife boyfriend girlfriend colleague coworker assistant secretary chair president captain customer guest tenant owner maintainer developer engineer reviewer chef kollege kollegin freund nachbarin nachbar professorin collègue ami amie voisin voisine jefe colega amigo amiga vecina chefe vizinha".split(),
    "place": "in at near to from outside between through past toward towards von nach bei über aus à dans vers depuis entre en desde hasta hacia cerca em para perto até".split(),
}
_NEAR = {k: frozenset(v) for k, v in NEAR.items()}
_WORDS = re.compile(r"[^\W\d_][\w’'.-]*[^\W_]|[^\W\d_]|[—–|<>(){}\";:=/]")
GENERATORS = {"email": _EMAIL, "phone": _PHONE, "id_number": _ID}
_MAYBE_MAIL = re.compile(r"@|＠|[\[(]at[\])]|\sat\s\S+\sdot\s", re.I)


def _shape(text: str) -> str:
    return re.sub(r"\d", "0", re.sub(r"[A-Z]", "A", text))


@lru_cache(maxsize=200_000)
def _known_phone(shape: str) -> int:
    """1 for a way to group the digits of a phone number that some country writes, 0 for another."""
    forms = (
        r"\+\d{1,3}([ .-]?\(?\d{1,5}\)?){2,6}", r"\(0{3}\) 0{3}[ -]0{4}", r"0{3}[.-]0{3}[.-]0{4}", r"0{2,3}\) ?0{3,4}-0{4}", r"\(0{2,4}\) 0{3,4} 0{4}", r"0{3} 0{4} 0{4}", r"0{5} 0{6}",
        r"0{2}( 0{2}){4}", r"0{3,5}[/-]0{4,8}(-0{1,4})?", r"0{2,4}-0{3,4}-0{4}", r"0{3} 0{3} 0{3}", r"0{3} 0{2} 0{2} 0{2}", r"0{11}", r"\(0{2}\) 0{4,5}-0{4}", r"0{3} 0{5} 0{3}",
    )
    return int(any(re.fullmatch(f.replace(r"\d", "0"), shape) for f in forms))


@lru_cache(maxsize=200_000)
def _known_id(shape: str) -> int:
    """1 for a way an identity number is written."""
    forms = (
        r"0{3}-0{2}-0{4}", r"AA ?0{2} ?0{2} ?0{2} ?A", r"A0{7}-?A", r"0{8}-?A", r"0{6}-0{7}", r"0 0{2} 0{2} [0A]{2} 0{3} 0{3}( 0{2})?", r"A[0A]{8,9}", r"0{3}\.0{3}\.0{3}-0{2}", r"0{4} 0{4} 0{4}",
        r"0{13,15}", r"AA0{6,7}A?", r"0{2} ?0{6} ?A ?0{3}",
    )
    return int(any(re.fullmatch(f, shape) for f in forms))


#: Words that open a sentence or a phrase, not a name.
_STARTERS = frozenset("when in at outside inside the of entry one a an which what how where after before since during near from to by with and but or if while as on our my your his her their its mein meine unser unsere ihr ihre sein seine mon ma mes notre nos votre mi mis nuestra nuestro su minha meu nossa nosso this that these those der die das ein eine im am an auf bei nach seit wie warum le la les un une des du en dans sur pour el los las una por con cómo o os as um uma no na em por como see visit about title read more new old yesterday today tomorrow then later last next every most early late ask tell call meet thank thanks dear hello hi mr mrs ms dr prof herr frau madame monsieur señor señora senhor senhora gestern heute morgen hier demain ayer hoy mañana ontem hoje so yet also only here there".split())
#: Words of places and of headings, which no person is called by.
_THINGS = frozenset("north south east west upper lower great little big old new port saint st bridge ferry falls hill hills haven town city village river lake bay park square station street road lane market castle church abbey island forest valley nord sud süd ost alt neu bad villa san santa vila vale monte fair festival museum hall house office club society library school archive guide notes note start source page pages issues reading model questions layout memory error data release releases system user table tables settings policy index chapter remarks words things work world day days week guide tips api types type code safety collection spring summer autumn winter monday tuesday wednesday thursday friday saturday sunday".split())
FEATURES = ["email", "phone", "id_number", "address", "name", "length", "digits", "letters", "groups", "upper", "plus", "bracket", "zero", "known_phone", "known_id", "dots", "comma", "words", "initial", "line_start", "line_end", "alone",
            *[f"before_{k}" for k in NEAR], *[f"first_{k}" for k in NEAR], *[f"last_{k}" for k in NEAR], *[f"after_{k}" for k in NEAR], "dash_before", "quote_before", "semi_near", "paren_before", "angle_near", "equals_before", "colon_before", "comma_before", "url", "code", "at_sign", "digits_name", "dotted_host", "local_service",
            "sentence_start", "csv", "starter", "thing", "number_next", "capital_before", "capital_after", "lower_after", "verb_after", "mail_after", "comma_after", "list_after", "particle", "east"]
_SERVICE = re.compile(r"^(?:git|root|admin|administrator|noreply|no-reply|donotreply|postmaster|daemon|www|build|ci|bot|deploy|backup|cron|nobody|support|info|alerts?|monitor\w*|jenkins|svc[\w-]*|service[\w-]*|mailer[\w-]*|hostmaster|webmaster|ops|system|node\d*|host\d*|db\d*)$", re.I)


_LOCAL = re.compile(r"\s?(?:@|\[at\]|\(at\)|＠)|\sat\s", re.I)
_AT_SIGN = re.compile(r"@|\[at\]|\(at\)|＠", re.I)
_FILE_HOST = re.compile(r"\.(?:png|jpe?g|gif|svg|js|css)$|^\d", re.I)
_INITIAL = re.compile(r"\b[A-Z]\.")
_LISTED = re.compile(r"\s?(?:,|and|und|et|y|e)\s[A-ZÀ-Þ]\w+\s[A-ZÀ-Þ]?\w+")
_OPENS = re.compile(r"(?:^|[.!?]\s)$")
_PAST = re.compile(r"\s(?:[a-zà-ÿ]+(?:ed|te|tten|ó|ou|a|é|s)|is|was|will|has|had|hat|ist|wird|est|sera|es|será|foi)\b")


@lru_cache(maxsize=100_000)
def _groups(word: str) -> tuple[int, ...]:
    """The lists of NEAR that a word is on."""
    return tuple(i for i, s in enumerate(_NEAR.values()) if word in s)


def _marks(words: list[str]) -> list[float]:
    out = [0.0] * len(_NEAR)
    for w in words:
        for i in _groups(w):
            out[i] = 1.0
    return out


def features(kind: str, text: str, start: int, end: int) -> list[float]:
    """A span as numbers: its kind and format, and what stands within BEFORE and AFTER characters on its line."""
    span = text[start:end]
    before, after = text[max(0, start - BEFORE) : start], text[end : end + AFTER]
    before, after = before[before.rfind("\n") + 1 :], after.split("\n", 1)[0]
    words = [w.lower().strip(".") for w in _WORDS.findall(before)][-6:]
    later = [w.lower().strip(".") for w in _WORDS.findall(after)][:3]
    plain = [w for w in words if w[:1].isalpha()]
    digits = sum(map(str.isdigit, span))
    shape = _shape(span) if digits else ""
    parts = span.split()
    tail, head = before.rstrip()[-1:], after.lstrip()[:1]
    mail = kind == "email"
    local = _LOCAL.split(span, maxsplit=1) if mail else ()
    next_word = later[0] if later and later[0][:1].isalpha() else ""
    return [
        float(mail), float(kind == "phone"), float(kind == "id_number"), float(kind == "address"), float(kind == "name"),
        len(span), digits, sum(map(str.isalpha, span)), len(_RUN.findall(span)) if digits else 0, float(span.isupper()), float(span[0] == "+"), float(span[0] == "(" or ")" in span[:5]), float(span[0] == "0"),
        _known_phone(shape.replace("A", "?")) if digits else 0, _known_id(shape) if digits else 0, span.count("."), float("," in span), len(parts), float(kind == "name" and _INITIAL.search(span) is not None),
        float(not before.strip()), float(not after.strip(" .")), float(not before.strip() and not after.strip()),
        *_marks(words), *_marks(words[-3:]), *_marks(plain[-1:]), *_marks(later),
        float(tail in ("—", "–", "-", "~")), float(tail == '"'), float(tail == ";" or head == ";"), float(tail in ("(", "（")), float(tail == "<" or head == "<"), float(tail == "="), float(tail in (":", "：")), float(tail == ","),
        float("://" in before.split(" ")[-1] or "/" in before[-1:]), float(before.count("`") % 2 == 1), float(mail and _AT_SIGN.search(span) is not None),
        float(len(local) == 2 and local[1][:1].isdigit()), float(len(local) == 2 and _FILE_HOST.search(local[1].strip()) is not None), float(mail and _SERVICE.match(local[0]) is not None),
        float(not before.strip() or _OPENS.search(before) is not None), float(before.count(";") + after.count(";") >= 1), float(kind == "name" and any(w.lower() in _STARTERS for w in parts)), float(kind == "name" and any(w.lower() in _THINGS or w.endswith("ing") for w in parts)), float(head.isdigit()),
        float(bool(plain) and _last_capital(before)), float(after[:1] == " " and after[1:2].isupper()), float(bool(next_word) and after.lstrip()[:1].islower()), float(kind == "name" and _PAST.match(after) is not None),
        float("@" in after[:30] or "(at)" in after or "[at]" in after), float(head == ","), float(_LISTED.match(after) is not None), float(len(parts) > 2), float(kind == "name" and not span.isascii() and not span[0].isupper()),
    ]


_RUN = re.compile(r"\d+")


def _last_capital(before: str) -> bool:
    """Whether the word right before is written with a capital."""
    word = before.rsplit(None, 1)[-1] if before[-1:] == " " else ""
    return word[:1].isupper() and word.lower().strip(".") not in _STARTERS


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that may be personal details, from every generator; they may overlap."""
    out = []
    if not text.isascii():
        out += [("name", *m.span()) for m in _NAME_EAST.finditer(text)]
    for m in _NAME.finditer(text):
        start, end = m.span(1)
        out.append(("name", start, end))
        if third := _THIRD.match(text, end):
            out.append(("name", start, third.end()))
    numbers = _RUN.search(text) is not None
    for start, end in addresses(text) if numbers else ():
        place = _PLACE.match(text, end)
        out.append(("address", start, place.end() if place else end))
    for kind, pattern in GENERATORS.items():
        if kind in ("phone", "id_number") and not numbers or kind == "email" and not _MAYBE_MAIL.search(text):
            continue
        for m in pattern.finditer(text):
            start, end = m.span()
            if end - start < (6 if kind == "id_number" else 8):
                continue
            if kind == "phone":
                while text[end - 1] in " ./-(":
                    end -= 1
                digits = sum(c.isdigit() for c in text[start:end])
                if not 8 <= digits <= 15 or "\n" in text[start:end] or re.match(r"(?:19|20)\d\d-\d\d-\d\d\b", text[start:end]):
                    continue
            elif kind == "id_number":
                span = text[start:end]
                if sum(c.isdigit() for c in span) < 6 or len(span) > 24:
                    continue
                if bare := re.match(r"[A-Z]{1,2} (?=\d)", span):
                    out.append((kind, start + bare.end(), end))
            elif kind == "email" and re.match(r"(?:me|us|him|her|them|it|is|was|look\w*)\s", m[0], re.I):
                inner = re.match(r"\w+ at ", m[0])
                if not inner or not (again := _EMAIL.match(text, start + inner.end())):
                    continue
                start, end = again.span()
            out.append((kind, start, end))
    return out


# Frames and formats that the training sentences are made of. {x} is where the detail stands.
_YES = {
    "email": ["Send the form to {x}.", "e-mail: {x}", "Reply to {x} by Friday", "Lea Ott <{x}>", '"email": "{x}"', "mailto:{x}?subject=hi", "my address is {x} now", "Lea Ott ({x})", "{x}, 030 12", "account {x} locked", "session of {x} from 10.0.0.1", "user: {x}", "이메일: {x}", "メール: {x} / 1", "schreiben Sie an {x}.", "écrire à Lea Ott ({x}).", "escribir a {x} hoy", "contacto: {x}", "{x}", "Lea Ott;{x};5", "either {x} or by post", "write to mailto:{x} instead", "12 | {x}", "user={x} id=4"],
    "phone": ["Ring {x} after six.", "Mobile: {x}", "Tel: {x}", "phone number {x}", "Fax: {x}", "{x} (office)", "reach us on {x}, please", "Telefon {x}", "Tél. : {x}", "teléfono {x}", "ligue para {x}", "전화 {x}", "電話 {x}", '"tel": "{x}"', "a@b.example, {x}", "{x}; a@b.example", "{x}", "Kontakt: {x}", "連絡 a@b.example / {x}", "{x} | a@b.example", "{x} – a@b.example", "{x}, or a@b.example", "Lea Ott\n{x}", "WhatsApp {x}", "dial {x} now", "call her, {x}, in the evening", "SMS: {x}"],
    "id_number": ["ID no. {x}", "national insurance {x}", "her identity card {x} expired", "social security number: {x}", "passport {x} was stolen", "Personalausweis {x}", "carte d’identité {x}", "numéro de sécu {x}", "documento {x}", "número de identidade {x}", "주민번호 {x}", "マイナンバー {x}", "Lea Ott;{x};5 Elm Street, Oakton", "tax id {x}", "NIF {x}", "identité : {x}", "it wants {x}, the identity number", "{x}", "Ausweis: {x}", "enter {x} as your id", "BI {x}"],
    "address": ["We moved to {x} last year.", "Deliver to {x}", "Home address: {x}", "Anschrift: {x}", "Dirección: {x}", "Adresse : {x}", "Endereço: {x}", "Lea Ott, {x}", "Lea Ott;1234;{x}", "(Lea Ott, {x}, aged 40)", "her flat at {x}", "Ich wohne {x}.", "Resido en {x}.", "{x}", "Post to:\n{x}\n", "come to {x} at noon", "the parcel went to {x}", "주소: {x}", "the house is {x}."],
    "name": ["I asked {x} to check the numbers.", "{x} sent me the minutes yesterday.", "Please forward this to {x}.", "Yours sincerely,\n{x}", "Kind regards\n{x}", "Signed: {x}", "Author: {x}", "Contact person: {x}", "Dear {x},", "Hello {x},", "Reported by {x} on Monday", "as {x} put it in the meeting", "with help from {x}, all went well", "{x} lives next door", "spoke to {x} about it", "wrote to {x}, who never answered", '"customer": "{x}"', '{"customer": "{x}", "tel": "1"}', "owner={x}", "{x} <a@b.example>", "From: {x} <a@b.example>", "{x}, 12 Elm Street, Oakton", "name;{x};44", "{x};AB 12;5 Elm Street", "{x};1234567;8 Elm Road, Oakton", "the guest ({x}, 5 Elm Street, Oakton, aged 40)", "Reviewer: {x}", "it works now, yet {x} is not convinced.", "the patch by {x} was merged", "credits: {x}", "-- {x}", "~ {x}", "– {x}", "PS: many thanks to {x} for this", "thanks go to {x}, who saw it", "I owe the idea to {x}.", "To: {x} <a@b.example>", "Cc: {x}, Lea Ott", "this is what {x} thinks", "it was mended, though {x} doubts it.",
             "{x}", "Ihre Ansprechpartnerin ist {x}.", "Mit freundlichen Grüßen\n{x}", "Frau {x} hat angerufen.", "laut {x} stimmt das nicht", "Wenden Sie sich an {x} (a@b.example).", "von {x} geprüft", "Rückfragen an {x} unter a@b.example.", "Fragen Sie bei {x} unter a@b.example nach.", "Bien à vous,\n{x}", "Demandez à {x} si besoin.", "selon {x}, c’est réglé", "Monsieur {x} a répondu", "Contactez {x} (a@b.example)", "Un saludo,\n{x}", "Pregunte a {x} por favor", "según {x} ya está", "la señora {x} llamó", "Hable con {x} (a@b.example)", "Fale com {x} (a@b.example)", "segundo {x}, está feito", "Atenciosamente,\n{x}", "작성자: {x}", "문의: {x} (a@b.example)", "連絡先 {x} まで", "作成者: {x}", "my neighbour {x} says so", "our manager {x} wrote it", "Yesterday {x} came by.", "On Monday {x} called twice", "Then {x} explained it all", "the new chair, {x}, will speak", "my boss, {x}, agrees with that", "Their doctor, {x}, was there.", "the mayor, {x}, opened the hall", "her uncle {x} owns a shop", "{x} explained how it works", "{x} replied at once", "ask my sister {x}", "Last week {x} suggested this.", "In the end {x} was right.", "the reviewer was {x}.", "letters by {x}", "written by {x}.", "{x} and I went home", "I met {x} in May", "{x} called me", "is {x} around?", "thank you, {x}!", "{x} (aged 40) won", "{x} 님", "어제 {x} 씨가 썼다", "昨日、{x}さんより", "that was done, but {x} objects.", "She said {x} knows more."],
}
_NO = {
    "email": (["pip install {x}", "use image {x}", "open {x} in the editor", "docker pull {x}", "git remote add origin {x}:a/b.git", 'src="{x}"', "scp {x}:/tmp/a .", "mail from {x} (automatic)", "the bot {x} replied", "ssh -p 22 {x}", "add {x} to the lock file", "`git fetch {x}:a`", "the file {x} is missing"], ["banner@2x.png", "photo@3x.jpg", "node@18.2.0", "git@host.example", "root@10.0.0.3", "ci@runner.example", "postgres@db1.example", "no-reply@shop.example", "react@17.0.2", "builder@jenkins.example", "daemon@box.invalid", "backup@store.host.example"]),
    "phone": (["Case {x} was closed.", "Job {x} failed", "tracking code {x}", "order {x} shipped", "sha {x}", "revision {x}", "port {x}", "host {x}", "ip {x}", "at {x} UTC", "uuid {x}", "ISBN {x}", "batch {x}", "serial number {x}", "invoice {x} is due", "v{x}", "version {x} came out", "upgrade from {x} today", "pid {x}", "the range {x} is free", "balance {x}", "coordinates {x}", "takes {x} ms", "{x} visitors", "Reference: {x}", "room {x}", "ticket #{x}", "ticket {x}", "Bestellung {x}", "Auftrag {x} ist da", "commande {x}", "pedido {x}", "주문 {x}", "注文 {x}", "build number {x}", "build {x}", "part no. {x}", "SKU {x}", "GET /x/{x}", "error code {x}", "event {x}", "timestamp {x}", "request {x} timed out", "{x} is only an order number", "listens on {x}:80", "id={x}&x=1"], None),
    "name": (["The chapter {x} is long.", "We met at {x}.", "the road from {x} to the sea", "{x} is a small town.", "near {x} the bridge", "a train to {x}", "{x} has three pubs.", "Chapters: {x}, Getting Started, Last Words.", "Chapters: Getting Started, {x} and Last Words.", "Contents: {x}, Final Words and Index Pages.", "the sections {x}, Last Words and Quick Tour", "the sections Last Words, {x} and Quick Tour", "the sections Last Words, Quick Tour and {x}.", "read {x} first", "# {x}", "## {x}", "Title: {x}", "the {x} page", "click {x} and wait", "File > {x}", "the {x} museum", "in {x}, where it rains", "between {x} and the river", "{x} sells apples for 3 a kilo", "{x} costs 12 pennies", "flights to {x} and back", "{x}: a short guide", "How {x} works", "Wie {x} funktioniert", "{x} liegt am Fluss", "À {x} il pleut", "En {x} llueve", "Em {x} chove", "the {x} festival opens", "{x} 2.0 was released", "the {x} manual", "page 3 of the {x} handbook", "the {x} app is free", "a {x} licence", "tolls at {x} are 4 pence.", "left {x} at noon with 20 sacks", "5 Elm Street, {x}.", "12345 {x}, next door", "goes to {x}. It is wet.", "It was wet. {x} pays 3 for 40.", "see {x} on page 3", "See {x}, {x} and the index.", "{x} repairs the old boats.", "{x} measures the map."], None),
    "address": (["about {x} were found", "the {x} of it", "some {x} later"], ["12 Open Road", "3 New Street", "40 Long Lane"]),
}
_NO["id_number"] = (_NO["phone"][0] + ["pin it to {x} now", "commit {x} broke it", "model {x}"], None)
_NO_NAMES = ["North Harwick", "Upper Denby", "Marlow Bridge", "Saint Oswald", "Port Ellery", "Great Tolland", "Little Haven", "Alt Reinfeld", "Villa Nueva", "Getting Started", "Known Issues", "Further Reading", "Data Model", "User Guide", "Open Questions", "Table Settings", "Deep Copy", "When Harwick", "In Denby", "Since Monday", "The Council", "Das Rathaus", "Der Bäcker", "Meine Wohnung", "Unser Verein", "Mon Bureau", "Nuestra Casa", "Nossa Rua", "Die Glasbläserin", "Le Port", "La Mairie", "El Puente", "O Porto", "Every Sunday", "Most Visitors", "Early Spring", "After Tolland", "Near Ellery", "Outside Reinfeld", "West Haven", "Denby Ferry", "Harwick Falls", "Old Ferry", "Garbage Collection", "Thread Safety", "Silver Fox", "Blue Lantern", "Iron Crown", "Red Panda", "Golden Key", "Harwick Denby"]
_NO_SHAPES = ["000-0000-00", "000000000000", "0000000000", "00.00.000-0000", "00000000-0000", "20000101-000000", "00.000.00.00", "000.0.0.000", "0.00.00.0000", "2000-01-01 10", "20000101", "A0000000", "00000000", "0A00000A", "0000-0000-00", "00-00000-000", "00 0000 00", "0000000.0000", "000000000"]
_GIVEN = "Ada Bruno Celia Dario Elif Farid Greta Hugo Ines Jonas Karla Leon Mona Nils Olga Pavel Rosa Selma Timo Vera Anouk Bastian Chiara Dmitri Esra Femke Gianni Hana Ilse Joris Keiko Lars Mira Naima Oskar".split()
_FAMILY = "Abbott Berger Costa Dupont Evans Fischer Garcia Holm Ivarsson Jensen Keller Lopes Moreau Novak Olsen Pereira Rossi Santos Tanner Vidal Ackermann Brandt Castro Delacroix Eriksson Fontaine Grabowski Haddad Iversen Jankowski Kowalski Lindqvist Mancini Nakamura Ortega".split()
_EAST_NAMES = ["김민수", "박서연", "이지훈", "佐藤花子", "山本 健", "田村明"]


def _made(rng: np.random.Generator, kind: str) -> str:
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    fill = lambda shape: "".join(str(rng.integers(10)) if c == "0" else chr(65 + int(rng.integers(26))) if c == "?" else c for c in shape)
    given, family = pick(_GIVEN), pick(_FAMILY)
    if kind == "email":
        name = pick([f"{given}.{family}", f"{given}_{fill('00')}", f"{given[0]}{family}", f"{family}{fill('00')}", f"{given}+forum", f"{given}-{family}"]).lower()
        host = pick([["mail", "example"], ["post", "host", "example"], ["inbox", "test"], ["old-mill", "example", "org"], ["web", "invalid"]])
        at, dot = pick([("@", "."), ("@", "."), ("[at]", "."), (" at ", " dot "), (" (at) ", " (dot) ")])
        out = name + at + dot.join(host)
        return out.upper() if rng.random() < 0.1 and at == "@" else out
    if kind == "phone":
        return fill(pick(["+44 20 0000 0000", "+1 000 555 0000", "(000) 555-0000", "000.555.0000", "1000550000", "10005500000", "+49 30 00000 000", "030/00000-000", "+33 1 00 00 00 00", "01 00 00 00 00", "(02) 5550 0000", "02) 555-0000", "+82-2-555-0000", "01632 960000", "020 0000 0000", "+55 11 00000-0000", "+34 900 000 000", "900 000 000", "+61 2 5550 0000", "+81-3-0000-0000", "03-0000-0000", "+91 00000 00000"]))
    if kind == "id_number":
        return fill(pick(["000-00-0000", "QQ 00 00 00 C", "QQ000000A", "X0000000-?", "00000000?", "000000-0000000", "1 00 00 00 000 000 00", "C00X00T000", "000.000.000-00", "0000 0000 0000", "L0?X0000?0"]))
    if kind == "address":
        number, street, town = str(rng.integers(1, 300)), pick(["Mill", "Station", "Old Church", "River", "Elm"]), pick(["Oakton", "Upper Vale", "Eastmouth"])
        return pick([
            f"{number} {street} {pick(['Close', 'Lane', 'Street', 'Road', 'Row', 'Avenue', 'Hill'])}, {town} X1 2YZ", f"Flat {fill('00')}, {number} {street} Lane, {town}", f"{number} {street} Avenue Apt {fill('00')}, {town}, ZZ 00{fill('000')}",
            f"{number}, rue des {street.split()[0]}s, {fill('00000')} {town}", f"Calle del {street.split()[0]} {number}, 3º B, {fill('00000')} {town}", f"Rua do {street.split()[0]} {number}, {town}", f"{street.split()[0]}straße {number}, {fill('00000')} {town}", f"{street.split()[0]}weg {number}a, {fill('00000')} {town}", f"PO Box {fill('000')}, {town} X1",
        ])
    if rng.random() < 0.06:
        return pick(_EAST_NAMES)
    return pick([f"{given} {family}", f"{given} {family}", f"{given} {family}", f"{given} {pick('ABCDEFGH')}. {family}", f"{given[0]}. {family}", f"{family.upper()}, {given}", f"{given} {pick(['van', 'de', 'von', 'da'])} {family}", f"{given} {pick(_GIVEN)} {family}"])


def _fill(rng: np.random.Generator, shape: str) -> str:
    return "".join(str(rng.integers(10)) if c == "0" else chr(65 + int(rng.integers(26))) if c == "?" else c for c in shape)


def training_rows(n: int = TRAINING_SENTENCES, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of features with labels, from sentences made of frames, and which of them belong to held-out frames.

    A candidate is right if it is the detail put in.
    """
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    lead = ["", "", "", "I tried it again. ", "Nothing helped so far.\n", "Version 2.4.11 is out. ", "Hinweis: ", "By the way, my sister Lea Ott wrote this part. ", "Assigned to Lea Ott by mail, ", "Ticket 12 on the server: ", "The phone and the passport are here. "]
    tail = ["", "", "", " and so on.", "\nThat is all.", " Thanks in advance!", " (see above)"]
    x, y, apart = [], [], []
    for _ in range(n):
        kind, right = TYPES[int(rng.choice(len(TYPES), p=[0.17, 0.2, 0.18, 0.1, 0.35]))], rng.random() < 0.5
        frames = _YES[kind] if right else _NO[kind][0]
        at = int(rng.integers(len(frames)))
        if right:
            value = _made(rng, kind)
        elif kind == "name":
            value = pick(_NO_NAMES)
        else:
            value = _fill(rng, re.sub(r"\d", "0", pick(_NO[kind][1]) if _NO[kind][1] else pick(_NO_SHAPES)))
        head = pick(lead)
        text = head + frames[at].replace("{x}", value) + pick(tail)
        start = len(head) + frames[at].index("{x}")
        for c, a, b in candidates(text):
            if b <= start or a >= start + len(value):
                continue
            x.append(features(c, text, a, b))
            y.append(float(right and c == kind and a == start and (b >= start + len(value) - 2 or c == "address") and (b <= start + len(value) or c != "name")))
            apart.append(at % HELD_OUT == HELD_OUT - 1)
    return np.array(x), np.array(y), np.array(apart)


@lru_cache(maxsize=1)
def fitted() -> tuple[Boosted, dict[str, float]]:
    """The trees, and the threshold of each type.

    Trees fitted without the held-out frames are judged on these, which gives the calibration and, for each type, the
    threshold with the best F1; the trees that are used know all frames.
    """
    x, y, apart = training_rows()
    fit = lambda rows: fit_boosted(x[rows], y[rows], rounds=45, depth=5, rate=0.3)
    part, model = fit(~apart), fit(np.ones(len(x), dtype=bool))
    part.slope, part.shift = model.slope, model.shift = calibrated(part, x[apart], y[apart])
    sure, thresholds = part.predict(x[apart]), {}
    for i, kind in enumerate(TYPES):
        own = x[apart][:, i] == 1
        grid = np.linspace(LOWEST, HIGHEST, 25)
        f1 = [2 * (y[apart][own] * (sure[own] >= t)).sum() / max(1.0, y[apart][own].sum() + (sure[own] >= t).sum()) for t in grid]
        best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
        thresholds[kind] = float(grid[best[len(best) // 2]])  # the middle of the best stretch
    return model, thresholds


def select(found: list[tuple[str, int, int]], scores, thresholds: dict[str, float]) -> list[tuple[str, int, int]]:
    """Spans over their threshold that don't overlap: addresses and mail addresses hold what stands inside them, then the likelier goes first."""
    rank = {"email": 0, "address": 0}
    kept = sorted((s for s in zip(found, scores) if s[1] >= thresholds[s[0][0]]), key=lambda s: (rank.get(s[0][0], 1), -s[1], s[0][1] - s[0][2], s[0][1]))
    out: list[tuple[int, int, str]] = []
    for (kind, a, b), _ in kept:
        i = bisect(out, (a, b, ""))
        if (i == 0 or out[i - 1][1] <= a) and (i == len(out) or b <= out[i][0]):
            out.insert(i, (a, b, kind))
    return [(kind, a, b) for a, b, kind in out]


SPAN = "array<struct<pii_type:string,span_start:int,span_end:int>>"


def _spans_udf(model):
    def run(texts: pd.Series) -> pd.Series:  # one batch of texts
        boosted, thresholds = model.value
        every = [candidates(t) if isinstance(t, str) else [] for t in texts]
        rows = [features(k, t, a, b) for t, c in zip(texts, every) for k, a, b in c]
        scores = boosted.predict(np.array(rows)) if rows else np.zeros(0)
        out, at = [], 0
        for c in every:
            taken = select(c, scores[at : at + len(c)], thresholds)
            at += len(c)
            out.append([{"pii_type": k, "span_start": a, "span_end": b} for k, a, b in taken])
        return pd.Series(out, index=texts.index, dtype=object)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return pandas_udf(run, SPAN).asNondeterministic()


def redact(text: str | None, spans) -> str | None:
    """The text with every span replaced by [TYPE]; the rest stays as it is."""
    if text is None:
        return None
    out, at = [], 0
    for s in spans:
        out += [text[at : s["span_start"]], f"[{s['pii_type'].upper()}]"]
        at = s["span_end"]
    return "".join([*out, text[at:]])


def pii_spans(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans) of every document with personal details; offsets are code points from 0.

    Null and empty texts hold none, rows with a null id are dropped, repeated rows count once in the result of
    p10_found, extra columns don't matter; long texts are read whole.
    """
    model = documents.sparkSession.sparkContext.broadcast(fitted())
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return rows.withColumn("spans", _spans_udf(model)("text")).where(F.size("spans") > 0)


def redacted(documents: DataFrame) -> DataFrame:
    """(doc_id, text) with placeholders, of the documents that hold personal details."""

    def run(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([redact(t, s) for t, s in zip(texts, spans)], index=texts.index, dtype=object)

    run.__annotations__ = {"texts": pd.Series, "spans": pd.Series, "return": pd.Series}
    return pii_spans(documents).select("doc_id", pandas_udf(run, "string")("text", "spans").alias("text"))


def p10_found(spark, sf_dir: str) -> DataFrame:
    """Mentions of personal details in documents."""
    spans = pii_spans(table(spark, sf_dir, "documents")).select("doc_id", F.explode("spans").alias("s"))
    return spans.select("doc_id", "s.pii_type", "s.span_start").distinct()


def p10_redacted(spark, sf_dir: str) -> DataFrame:
    """Documents with their personal details replaced."""
    return redacted(table(spark, sf_dir, "documents")).distinct()
