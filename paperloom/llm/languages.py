"""Function words and word endings of European languages, and what can be told from them."""

from __future__ import annotations

import re

# Frequent function words of each language, lower case.
FUNCTION_WORDS = {
    "en": "the of and to in is was for on with by be that a an at from or not will has have had were are it its this which as but if "
    "their they he she we you your our his her can could may must should would been than there these those who what when about into before after any all no",
    "de": "der die das und ist von zu den dem des ein eine einer einem einen im am in mit auf für nicht sich auch es wird werden wurde wurden war sind "
    "ihr ihre ihrem ihren ihrer sie wir er als bei nach aus zum zur über oder aber wenn dass kann unter bis hat haben durch um noch nur vor wie",
    "fr": "le la les de des du et est un une en dans pour par sur au aux que qui ne pas il elle nous vous ce cette ces son sa ses leur leurs ou mais "
    "avec sont a été être plus se dont si comme sans même après avant entre jusqu nos votre notre",
    "es": "el la los las de del y es un una en por para con que no se su sus al lo como más pero fue ha han ser son está este esta estos estas o si "
    "a e qué nos le les entre sin sobre hasta desde durante tras muy también cuando donde",
}
WORDS = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}
ANY = frozenset().union(*WORDS.values())
#: Word to the languages that have it, for counting votes in one look-up.
VOTES = {w: tuple(lang for lang in WORDS if w in WORDS[lang]) for w in sorted(ANY)}

# Further languages in which an answer may come although nobody asked for them.
FURTHER_WORDS = {
    "it": "il lo la i gli le di del della dei delle e è un una che non per con da dal nel nella al alla sono si su questo questa come ma più anche due esse tra perché",
    "pt": "o a os as de do da dos das e é um uma que não por para com em no na nos nas ao à se mais como foi são este esta também porque",
    "nl": "de het een van en is in op te dat die voor met niet zijn aan er om ook als maar door bij naar uit worden deze dit omdat",
}
#: Word to languages, of all seven.
ANSWER_VOTES = {
    w: tuple(lang for lang, words in {**FUNCTION_WORDS, **FURTHER_WORDS}.items() if w in words.split())
    for w in {w for words in (*FUNCTION_WORDS.values(), *FURTHER_WORDS.values()) for w in words.split()}
}
# Endings and letters that are usual in one language and rare in the others.
ENDINGS = {
    "en": re.compile(r"(?:th|wh)\w+|\w+(?:ing|ed|ly|ness|ght|tion)\b"),
    "de": re.compile(r"\w+(?:ung|keit|heit|lich|isch|ten|gen|chen|schaft)\b|\w*[äöüß]\w*"),
    "fr": re.compile(r"\b(?:l|d|qu|n|s|c|j)['’]\w+|\w*[èêçàùœ]\w*|\w+(?:eux|ment|é|ée|és|aux|eur|oir)\b"),
    "es": re.compile(r"\w*[ñ¿¡]\w*|\w+(?:ción|ciones|dad|miento|ado|ada|ar|os|as)\b|\w*[áíóú]\w*"),
    "it": re.compile(r"\w+(?:zione|zioni|ità|mento|are|ere|ato|ata|gli|zza|ssi)\b|\b(?:dell|nell|all|un)['’]\w+"),
    "pt": re.compile(r"\w*[ãõ]\w*|\w+(?:ção|ções|dade|mento)\b"),
    "nl": re.compile(r"\w*(?:ij|aa|oo|uu)\w*|\w+(?:heid|lijk|atie)\b"),
}
# Letters that only one of the languages writes.
LETTERS = {"de": "äß", "fr": "êîûœ", "es": "ñ¿¡", "pt": "ãõ"}
