"""Ordinary language that no corpus is needed for: sentences of everyday life in eight languages, and words of public vocabularies."""

from __future__ import annotations

import base64
import re
from collections.abc import Sequence

#: Vocabularies whose pieces stand for natural words: one base64 piece and its rank a line.
VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


def pieces(paths: Sequence[str] = VOCABULARIES) -> list[tuple[str, int]]:
    """(piece, rank) of all pieces that are text."""
    out = []
    for path in paths:
        with open(path, "rb") as f:
            for line in f:
                a, rank = line.split()
                try:
                    t = base64.b64decode(a).decode()
                except UnicodeDecodeError:
                    continue
                if t.strip():
                    out.append((t, int(rank)))
    return out


def words(paths: Sequence[str] = VOCABULARIES, most: int = 40_000) -> list[str]:
    """Words of two letters or more, frequent ones first."""
    found = ((r, t[1:].lower()) for t, r in pieces(paths) if t[0] == " " and t[1:].isalpha() and len(t) > 2)
    return list(dict.fromkeys(t for _, t in sorted(found)))[:most]


_SENTENCES = {
    "en": """could you send me the report before noon | happy new year to you and your family | my cat sleeps on the sofa all day | the dog runs along the beach in the morning | thank you so much for your quick reply | where did you buy those shoes, they look great | I am sorry to hear that you are ill, get well soon | you are a great teacher and everybody in the class knows it | you are my best friend | what a lovely garden you have | she is a wonderful doctor | he is nothing but kind | your mother is a nurse, isn't she | look at this picture from the mountains | shut the door please, it is cold | you should be proud of your work | people like you make this town a better place | I hope you enjoy the film | I hope you feel better soon | I will find you a seat in the hall and bring your coat | I will call you tomorrow evening | keep talking to your neighbours | we know where you can find good bread | watch the road, it is icy | next time I see you I will bring the book | your children will love this game | all teachers are invited to the meeting | the farmers sell apples at the market | they moved to a bigger house last spring | go to the library and ask for the map | nobody was hurt in the accident | the process ended because it ran out of memory | the job was killed after the node used too much memory | stop the server, clear the cache and start it again | the function returns a list of names | an exception is raised if the argument is negative | this method is called when an instance is created | the attack on the bridge was in the news | the soldiers were shot at near the border, the agency reports | a man was arrested after he hit a policeman | the novel tells of a murder in a village | doctors treat the infection with antibiotics | the patient complains of pain in the chest and legs | the lesson is about love, sex and responsibility | women and men were asked about their health | the sculpture shows a naked woman | hot soup and fresh bread for two | young people want to study abroad | boil the eggs for eight minutes and peel them | add salt, pepper and a little oil | the match ended in a draw after extra time | they won the cup for the third time | shares fell by two percent on monday | the new law comes into force next month | the train to the city leaves at nine | turn left at the church and go straight on | it rained all week and the field is wet | the museum is free on sundays | he plays the piano and she sings | can you help me move the table | what time does the shop close | we had a great time at the lake | the baby slept through the night | I forgot my keys at the office | please sign the form and return it by post | the contract ends in june | this phone has a good camera but a poor battery | the food was cold and the waiter was slow | I don't like the colour of the wall | that was a bad idea, let's try something else | my old car is dirty and slow | the dirty water ran down the street | this soup is disgusting, said the child | a rotten apple lay in the basket | the fat cat lay in the sun | an ugly building stands at the corner | rats were seen in the cellar of the school | the pig and the dog live on one farm | the worm crawled through the earth | he lost the game but he is no loser | I was such a fool to believe it | they burn wood in the stove | the house burned down after lightning struck | kill the lights and close the windows | this joke kills me | I am dying to see you""",
    "de": """kannst du mir den Bericht bis Mittag schicken | alles Gute zum Geburtstag und einen schönen Tag | meine Katze schläft den ganzen Tag auf dem Sofa | vielen Dank für die schnelle Antwort | du bist eine tolle Lehrerin und alle wissen das | du bist mein bester Freund | mach bitte die Tür zu, es ist kalt | ich hoffe, der Film gefällt dir | ich finde dich sehr nett | ich bringe dir morgen das Buch | alle Lehrer sind zum Treffen eingeladen | die Bauern verkaufen Äpfel auf dem Markt | der Prozess wurde beendet, weil der Speicher voll war | der Roman erzählt von einem Mord im Dorf | ein Mann wurde festgenommen, weil er einen Polizisten schlug | Frauen und Männer wurden nach ihrer Gesundheit gefragt | die Eier acht Minuten kochen und schälen | das Spiel endete unentschieden | der Zug fährt um neun | es hat die ganze Woche geregnet | das schmutzige Wasser lief die Straße hinunter | der Hund und das Schwein leben auf einem Hof | das Essen war kalt und der Kellner langsam | das Haus brannte nach einem Blitzschlag ab | die Verbindung nach Norden ist heute nicht verfügbar | kannst du die Kinder von der Schule abholen | der Ausdruck wird von links nach rechts ausgewertet""",
    "fr": """peux-tu m'envoyer le rapport avant midi | bon anniversaire et bonne journée | mon chat dort toute la journée sur le canapé | merci beaucoup pour votre réponse rapide | tu es une très bonne amie et tu le sais | ferme la porte, il fait froid | j'espère que le film te plaira | je vais te trouver une place et t'apporter un café | je vais t'appeler demain | tous les professeurs sont invités à la réunion | les paysans vendent des pommes au marché | le roman raconte un meurtre dans un village | un homme a été arrêté après avoir frappé un policier | les femmes et les hommes ont été interrogés sur leur santé | faites cuire les œufs huit minutes | le match s'est terminé par un nul | le train part à neuf heures | il a plu toute la semaine | l'eau sale coulait dans la rue | le chien et le porc vivent à la ferme | le repas était froid | la maison a brûlé après l'orage | la ligne du nord n'est pas disponible aujourd'hui | peux-tu aller chercher les enfants à l'école | l'expression est évaluée de gauche à droite""",
    "es": """puedes enviarme el informe antes del mediodía | feliz cumpleaños y que tengas un buen día | mi gato duerme todo el día en el sofá | muchas gracias por la respuesta rápida | eres una buena amiga y todos lo saben | cierra la puerta, hace frío | espero que te guste la película | te voy a encontrar un sitio y traerte un café | te voy a llamar mañana | todos los profesores están invitados a la reunión | los campesinos venden manzanas en el mercado | la novela cuenta un asesinato en un pueblo | detuvieron a un hombre que golpeó a un policía | preguntaron a mujeres y hombres por su salud | hierve los huevos ocho minutos | el partido terminó en empate | el tren sale a las nueve | llovió toda la semana | el agua sucia corría por la calle | el perro y el cerdo viven en la granja | la comida estaba fría | la casa se quemó tras la tormenta | la línea del norte no está disponible hoy | puedes recoger a los niños del colegio | la expresión se evalúa de izquierda a derecha""",
    "pt": """podes enviar-me o relatório antes do meio-dia | feliz aniversário e tenha um bom dia | o meu gato dorme o dia todo no sofá | muito obrigado pela resposta rápida | és uma boa amiga e toda a gente sabe | fecha a porta, está frio | espero que gostes do filme | vou encontrar-te um lugar e trazer-te um café | vou telefonar-te amanhã | todos os professores estão convidados para a reunião | os agricultores vendem maçãs no mercado | o romance conta um assassínio numa aldeia | um homem foi preso depois de bater num polícia | perguntaram a mulheres e homens pela sua saúde | coza os ovos durante oito minutos | o jogo acabou empatado | o comboio parte às nove | choveu a semana toda | a água suja corria pela rua | o cão e o porco vivem na quinta | a comida estava fria | a casa ardeu depois da trovoada | a linha do norte não está disponível hoje | podes ir buscar as crianças à escola | a expressão é avaliada da esquerda para a direita""",
    "it": """puoi mandarmi il rapporto prima di mezzogiorno | buon compleanno e buona giornata | il mio gatto dorme tutto il giorno sul divano | grazie mille per la risposta veloce | sei una buona amica e lo sanno tutti | chiudi la porta, fa freddo | spero che il film ti piaccia | ti troverò un posto e ti porterò un caffè | ti chiamo domani | tutti gli insegnanti sono invitati alla riunione | i contadini vendono mele al mercato | il romanzo racconta un omicidio in un paese | un uomo è stato arrestato dopo aver colpito un poliziotto | a donne e uomini è stato chiesto della loro salute | bollite le uova otto minuti | la partita è finita in parità | il treno parte alle nove | ha piovuto tutta la settimana | l'acqua sporca scorreva per strada | il cane e il maiale vivono in fattoria | il cibo era freddo | la casa è bruciata dopo il temporale | la linea del nord oggi non è disponibile | puoi andare a prendere i bambini a scuola | l'espressione viene valutata da sinistra a destra""",
    "ru": """можешь прислать мне отчёт до полудня | с днём рождения и хорошего дня | мой кот весь день спит на диване | большое спасибо за быстрый ответ | ты хорошая подруга, и все это знают | закрой дверь, холодно | надеюсь, тебе понравится фильм | я найду тебе место и принесу кофе | я тебе завтра позвоню | все учителя приглашены на собрание | крестьяне продают яблоки на рынке | роман рассказывает об убийстве в деревне | мужчину задержали за то, что он ударил полицейского | женщин и мужчин спросили о здоровье | варите яйца восемь минут | матч закончился вничью | поезд отходит в девять | всю неделю шёл дождь | грязная вода текла по улице | собака и свинья живут на ферме | еда была холодной | дом сгорел после грозы | северная линия сегодня недоступна | можешь забрать детей из школы | выражение вычисляется слева направо""",
    "uk": """можеш надіслати мені звіт до полудня | з днем народження і гарного дня | мій кіт весь день спить на дивані | щиро дякую за швидку відповідь | ти хороша подруга, і всі це знають | зачини двері, холодно | сподіваюсь, тобі сподобається фільм | я знайду тобі місце і принесу каву | я тобі завтра зателефоную | усі вчителі запрошені на збори | селяни продають яблука на ринку | роман розповідає про вбивство в селі | чоловіка затримали за те, що він ударив поліцейського | жінок і чоловіків запитали про здоров'я | варіть яйця вісім хвилин | матч закінчився внічию | потяг відходить о дев'ятій | увесь тиждень ішов дощ | брудна вода текла вулицею | собака і свиня живуть на фермі | їжа була холодна | будинок згорів після грози | північна лінія сьогодні недоступна | можеш забрати дітей зі школи | вираз обчислюється зліва направо""",
}


def sentences() -> list[tuple[str, str]]:
    """(language, sentence)"""
    return [(k, s.strip()) for k, v in _SENTENCES.items() for s in re.split(r"\||\n", v)]
