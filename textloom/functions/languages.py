"""A small language scorer without a model file: scripts, and the commonest words of languages in Latin script."""

from __future__ import annotations

import math
import re

_WORDS = {
    "en": "the of and to in is that it for was on are with as his they be at this have from or had by but not what all were we when your can said there an each which she do how their if will",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son aux d'un cette ont ses mais comme ou nous leur été",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también",
    "it": "di e il la che in a per un è del non una con si le dei da al sono i della come più anche nel ha lo o alla gli delle ma su se questo essere suo loro",
    "pt": "de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou quando muito nos já eu também só pelo pela até isso",
    "nl": "de van het een en in is dat op te zijn met voor niet aan er om ook als dan maar bij of uit nog naar heeft ze was door over hij worden wordt deze tot",
    "sv": "och i att det som en på är av för med den till inte om ett han de var jag sig men har från vid så nu man när kan eller hade vi",
    "da": "og i at det en er til på den af for med der ikke de som et har fra han var jeg vi kan sig men også om skal efter ved blev",
    "no": "og i det er som på en til at av for med den ikke har de var et jeg fra han vi om kan sig men også skal etter ved ble seg",
    "fi": "ja on ei se että hän oli en ovat mutta kun tämä niin kuin olla mitä myös joka vain ole sen jos mukaan ollut jo",
    "pl": "i w na z się do nie że to jest o jak po za od przez dla tak co ale przy był jego są tym czy oraz tylko już może",
    "cs": "a v se na je že s z do to o i ve jako za by pro které jeho jsou po ale není být tak podle jsem byl když také",
    "tr": "ve bir bu da de için ile olarak çok daha olan gibi en ne o kadar sonra ama var her mi değil ki ise ya",
    "ro": "de și în a la cu pe din care o un nu ca sau este să mai pentru prin fi dar sunt au al ce după lui",
    "hu": "a az és hogy nem is egy ez meg volt de ha csak már mint vagy még el azt van kell lesz ki be",
    "id": "yang dan di ini dengan untuk dari tidak dalam akan pada itu juga ke karena ada oleh sudah saya atau mereka bisa",
    "vi": "và của là có trong không được cho các một người với này đã những khi để từ đến như ra về",
}
_SETS = {lang: frozenset(words.split()) for lang, words in _WORDS.items()}
_SCRIPTS = {
    "ja": r"[\u3040-\u30ff]", "zh": r"[\u4e00-\u9fff]", "ko": r"[\uac00-\ud7af]", "ru": r"[\u0400-\u04ff]", "ar": r"[\u0600-\u06ff]", "he": r"[\u0590-\u05ff]",
    "el": r"[\u0370-\u03ff]", "th": r"[\u0e00-\u0e7f]", "hi": r"[\u0900-\u097f]", "bn": r"[\u0980-\u09ff]", "ta": r"[\u0b80-\u0bff]", "ka": r"[\u10a0-\u10ff]", "hy": r"[\u0530-\u058f]",
}
_SCRIPTS = {lang: re.compile(x) for lang, x in _SCRIPTS.items()}
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
#: Words that a text is taken to hold of every language beside those it does, and the weight of a common word against them.
_PRIOR, _WEIGHT = 1.0, 6.0


def languages(text: str) -> dict[str, float]:
    """Probabilities of languages, by falling ones; none for a text without a letter."""
    letters = sum(map(str.isalpha, text))
    if not letters:
        return {}
    counts = {lang: len(x.findall(text)) for lang, x in _SCRIPTS.items()}
    if counts["ja"] and counts["ja"] * 10 >= counts["zh"]:  # kana stand among Han characters in Japanese alone
        counts["ja"] += counts.pop("zh")
    out = {lang: n / letters for lang, n in counts.items() if n}
    latin = max(0.0, 1 - sum(out.values()))
    if latin > 0:
        words = _WORD.findall(text.lower())
        hits = {lang: sum(w in its for w in words) for lang, its in _SETS.items()}
        most = max(hits.values(), default=0)
        z = {lang: math.exp(_WEIGHT * (n - most) / (math.sqrt(most) + _PRIOR)) for lang, n in hits.items()}
        total = sum(z.values())
        for lang, v in z.items():
            out[lang] = out.get(lang, 0.0) + latin * v / total
    total = sum(out.values())
    return dict(sorted(((lang, p / total) for lang, p in out.items() if p / total > 1e-4), key=lambda x: (-x[1], x[0])))
