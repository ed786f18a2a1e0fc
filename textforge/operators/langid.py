"""The language of a text, by its character trigrams: profiles are learnt from labelled texts, scored in columns.

Trigrams are dealt to buckets by a hash, so a profile has the same size whatever it is learnt from, and a lookup is a place
in an array. A text's score for a language is the sum of its trigrams' log probabilities there, with a share of a count
added to every bucket. Languages without labelled texts are learnt from the sample sentences below.
"""

from __future__ import annotations

import dataclasses
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textforge.functions import text as T

#: Characters of a text that are looked at, buckets of trigrams, and what is added to each bucket's count.
HEAD, BUCKETS, ADDED = 800, 8192, 0.5

#: Sentences of everyday words, written for this module, with each language's function words.
SAMPLES = {
    "nl": (
        "De kinderen lopen na schooltijd met hun vrienden naar het park, waar zij de hele middag spelen tot het donker wordt. Wij zoeken een nieuwe collega die graag samenwerkt en goed kan luisteren. "
        "Het is belangrijk dat u op tijd bent, want de vergadering begint om negen uur en duurt niet lang. Voor deze functie heb je ervaring met het bouwen en onderhouden van kleine websites. "
        "Er zijn veel mogelijkheden om te leren, en je krijgt daarbij hulp van onze mensen. Toen zij gisteren thuiskwam, stond de fiets nog altijd buiten in de regen. Als het morgen weer mooi weer is, "
        "gaan wij met zijn allen naar zee. Hij heeft nooit begrepen waarom zijn buurman zo vroeg opstaat. Je werkt vier dagen per week en kunt ook een dag van huis uit werken. Wat vind jij daarvan? "
        "Ook wie geen diploma heeft maar wel wil leren, mag zich bij ons melden. De trein naar de stad vertrekt elk half uur vanaf spoor twee."
    ),
    "it": (
        "I bambini vanno al parco con gli amici dopo la scuola e giocano tutto il pomeriggio finché non diventa buio. Cerchiamo una nuova collega che lavori volentieri con gli altri e sappia ascoltare. "
        "È importante arrivare in orario, perché la riunione comincia alle nove e non dura molto. Per questo lavoro hai già esperienza nel costruire e curare piccoli siti. Ci sono molte possibilità di imparare, "
        "e le nostre persone ti aiutano ogni giorno. Quando ieri è tornata a casa, la bicicletta era ancora fuori sotto la pioggia. Se domani il tempo sarà bello, andremo tutti insieme al mare. "
        "Non ha mai capito perché il suo vicino si alzi così presto. Si lavora quattro giorni alla settimana, uno anche da casa. Che cosa ne pensi? Anche chi non ha un diploma ma vuole imparare può scriverci. "
        "Il treno per la città parte ogni mezz'ora dal secondo binario, e della sua puntualità nessuno dubita."
    ),
    "en": (
        "After school the children walk to the park with their friends and play there all afternoon until it gets dark. We are looking for a new colleague who likes to work with others and listens well. "
        "It is important that you are on time, because the meeting starts at nine and does not take long. For this job you have some experience with building small websites and looking after them. "
        "There are many ways to learn, and our people will help you every day. When she came home yesterday, the bicycle was still standing outside in the rain. If the weather is fine tomorrow, "
        "we shall all go to the sea. He has never understood why his neighbour gets up that early. You work four days a week, one of which can be from home. What do you think? "
        "Those without a diploma who would like to learn should write to us too. The train to the city leaves every half hour."
    ),
    "fr": (
        "Après l'école, les enfants vont au parc avec leurs amis et y jouent tout l'après-midi jusqu'à la nuit. Nous cherchons une nouvelle collègue qui aime travailler avec les autres et qui sache écouter. "
        "Il est important d'arriver à l'heure, car la réunion commence à neuf heures et ne dure pas longtemps. Pour ce poste, vous avez déjà construit de petits sites et vous savez les entretenir. "
        "Il y a beaucoup de moyens d'apprendre, et nos équipes vous aident chaque jour. Quand elle est rentrée hier, le vélo était encore dehors sous la pluie. S'il fait beau demain, nous irons tous à la mer. "
        "Il n'a jamais compris pourquoi son voisin se lève si tôt. On travaille quatre jours par semaine, dont un chez soi. Qu'en pensez-vous ? Ceux qui n'ont pas de diplôme mais veulent apprendre peuvent aussi nous écrire. "
        "Le train pour la ville part toutes les demi-heures."
    ),
    "de": (
        "Nach der Schule gehen die Kinder mit ihren Freunden in den Park und spielen dort den ganzen Nachmittag, bis es dunkel wird. Wir suchen eine neue Kollegin, die gern mit anderen arbeitet und gut zuhören kann. "
        "Es ist wichtig, dass Sie pünktlich sind, denn die Besprechung beginnt um neun Uhr und dauert nicht lange. Für diese Stelle haben Sie schon kleine Seiten gebaut und gepflegt. "
        "Es gibt viele Möglichkeiten zu lernen, und unsere Leute helfen Ihnen jeden Tag. Als sie gestern nach Hause kam, stand das Fahrrad noch immer draußen im Regen. Wenn das Wetter morgen schön ist, "
        "fahren wir alle zusammen ans Meer. Er hat nie verstanden, warum sein Nachbar so früh aufsteht. Man arbeitet vier Tage in der Woche, einen davon auch zu Hause. Was halten Sie davon? "
        "Auch wer keinen Abschluss hat, aber lernen möchte, darf uns schreiben. Der Zug in die Stadt fährt jede halbe Stunde."
    ),
    "es": (
        "Después de la escuela, los niños van al parque con sus amigos y juegan allí toda la tarde hasta que oscurece. Buscamos una nueva compañera a la que le guste trabajar con otros y sepa escuchar. "
        "Es importante llegar a tiempo, porque la reunión empieza a las nueve y no dura mucho. Para este puesto ya tienes alguna experiencia en hacer y cuidar sitios pequeños. "
        "Hay muchas maneras de aprender, y nuestra gente te ayuda cada día. Cuando ella volvió ayer a casa, la bicicleta todavía estaba fuera bajo la lluvia. Si mañana hace buen tiempo, iremos todos juntos al mar. "
        "Él nunca ha entendido por qué su vecino se levanta tan temprano. Se trabaja cuatro días a la semana, uno de ellos desde casa. ¿Qué te parece? También quien no tiene título pero quiere aprender puede escribirnos. "
        "El tren a la ciudad sale cada media hora."
    ),
}


@dataclasses.dataclass(frozen=True)
class Profiles:
    """Log probabilities of each bucket in each profile, in order of their codes; a language can have several profiles."""

    codes: tuple[str, ...]
    scores: tuple[tuple[float, ...], ...]

    @classmethod
    def of(cls, counts: Iterable[tuple[str, Counter]]) -> Profiles:
        """From counts by bucket, each with its language."""
        given = sorted(((c, n) for c, n in counts if n), key=lambda x: x[0])
        return cls(tuple(c for c, _ in given), tuple(tuple(round(math.log((n[b] + ADDED) / (sum(n.values()) + ADDED * BUCKETS)), 4) for b in range(BUCKETS)) for _, n in given))


def buckets(text: str) -> list[int]:
    """The buckets of the trigrams of a text's words, each between two blanks."""
    words = (f" {w} " for w in re.findall(r"[^\W\d_]+", text.lower()))
    return [zlib.crc32(w[i : i + 3].encode()) % BUCKETS for w in words for i in range(len(w) - 2)]


def buckets_of(text: Column) -> Column:
    """Array of the buckets of the trigrams of a text's first characters; null counts as empty."""
    words = F.regexp_extract_all(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, HEAD)), F.lit(r"\p{L}+"), F.lit(0))
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.crc32(F.substr(w, i, F.lit(3)).cast("binary")) % BUCKETS))
    return F.flatten(grams)


def samples(codes: Iterable[str] = tuple(SAMPLES)) -> list[tuple[str, Counter]]:
    return [(c, Counter(buckets(SAMPLES[c]))) for c in codes]


def built_in() -> Profiles:
    """Profiles of the sample sentences alone."""
    return Profiles.of(samples())


def learnt(df: DataFrame, text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles of the languages of a labelled table, beside those of the sample sentences.

    Trigrams are counted in one aggregation; at most BUCKETS counts of each language reach the driver. Rows without a
    label, or without a letter, teach nothing.
    """
    rows = df.where(F.coalesce(F.col(lang), F.lit("")) != "").select(F.col(lang).alias("lang"), F.explode(buckets_of(F.col(text))).alias("bucket"))
    counts: dict[str, Counter] = {}
    for r in rows.groupBy("lang", "bucket").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["lang"], Counter())[r["bucket"]] = r["n"]
    return Profiles.of([*counts.items(), *samples()])


def language(text: Column, profiles: Profiles) -> Column:
    """The code of the likeliest language of a text's first 800 characters; ties go by the alphabet, a text without a letter is 'unknown'."""
    tables = [T.constant(list(p), "array<double>") for p in profiles.scores]
    codes = F.array(*map(F.lit, profiles.codes))
    total = lambda found, table: F.aggregate(found, F.lit(0.0), lambda a, b: a + F.element_at(table, b.cast("int") + 1))
    sums = lambda found: F.array(*[total(found, t) for t in tables])
    best = lambda s: F.element_at(codes, F.array_position(s, F.array_max(s)).cast("int"))
    return T.once(buckets_of(text), lambda found: F.when(F.size(found) > 0, T.once(sums(found), best)).otherwise("unknown"))
