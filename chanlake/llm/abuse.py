"""Abusive, hateful and sexual content: a score for every text.

The model is a bidirectional gated recurrent network with attention pooling, written and trained in numpy. Its input
is a word vector plus the mean of the vectors of the word's character n-grams, so that disguised and
unseen spellings are read by their characters. A text is scored on all windows of ``WINDOW`` words, one at each word; its
score is the highest of them.
It is trained from the phrases below, in eight languages, with names, disguises and surroundings drawn at random
from a fixed seed. Ordinary language is everyday sentences (:mod:`.ordinary`), sequences of function words and
words of public vocabularies, and a bounded sample of the texts themselves (``SAMPLE``) without those that have a word of the phrases.
Training is repeatable and takes under a minute; the trained parameters are kept in the shared folder under the
hash of all that they depend on (:func:`stored`).

Defined results: a null text and one without words score 0.
"""

from __future__ import annotations

import hashlib
import inspect
import pickle
import random
import re
import sys
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..plans.scratch import read_bytes, shared_dir, write_bytes
from . import languages, lookalikes, ordinary

WINDOW, HIDDEN, SLOTS = 16, 16, 1 << 12
#: Texts of the corpus that stand for ordinary language in training, at most, and windows of random ordinary words.
SAMPLE, RANDOM = 6_000, 4_000
#: Windows scored at a time, so that their states stay in the processor's cache.
BATCH = 1024
#: Texts with a higher score count as abusive.
THRESHOLD = 0.9

# -- phrases ------------------------------------------------------------------------------------------
# {i} insult, {a} adjective, {w} who is meant, {g} group, {p} place, {b} body part, {n} number.

_INSULT = {
    "en": ("idiot moron imbecile loser coward bastard asshole dumbass scumbag clown trash pig parasite bitch whore slut prick jerk dickhead retard cunt scum filth vermin dog worm fool piece_of_shit piece_of_trash waste_of_air waste_of_space son_of_a_bitch", "stupid ugly pathetic worthless miserable filthy rotten brainless disgusting dumb useless fucking dirty fat lazy vile"),
    "de": ("Idiot Trottel Arschloch Mistkerl Drecksack Schwachkopf Vollpfosten Wichser Hurensohn Schlampe Versager Penner Dummkopf Schwein Miststück Abschaum Blödmann Vollidiot Missgeburt Feigling Parasit", "dumm hässlich widerlich nutzlos elender dreckiger erbärmlicher blöder verdammter stinkender mieser fauler"),
    "fr": ("connard connasse salaud abruti crétin imbécile idiot débile ordure déchet salope pute enfoiré bouffon raclure merde porc minable lâche parasite fils_de_pute", "sale débile infect répugnant pitoyable stupide pauvre misérable dégoûtant inutile moche gros"),
    "es": ("idiota imbécil cabrón gilipollas payaso inútil basura estúpido mierda puta zorra cerdo cobarde parásito desgraciado escoria rata tonto hijo_de_puta capullo", "asqueroso repugnante miserable estúpido patético inútil maldito sucio feo gordo podrido"),
    "pt": ("idiota imbecil palhaço burro verme lixo otário cretino cabrão puta vadia porco cobarde covarde parasita desgraçado merda estúpido filho_da_puta nojento", "nojento patético inútil burro estúpido miserável maldito sujo feio podre repugnante"),
    "it": ("idiota cretino imbecille bastardo stronzo pagliaccio verme feccia scemo coglione puttana troia maiale vigliacco parassita deficiente merda figlio_di_puttana rifiuto", "schifoso patetico inutile stupido miserabile lurido maledetto brutto sporco ridicolo marcio"),
    "ru": ("идиот придурок мразь урод тварь ничтожество дебил кретин ублюдок сволочь скотина свинья паразит трус дурак мудак сука шлюха козёл тупица гнида отброс", "тупой вонючий мерзкий никчёмный жалкий грязный гнусный паршивый гнилой"),
    "uk": ("ідіот придурок мерзота виродок тварюка нікчема дебіл кретин ублюдок сволота скотина свиня паразит боягуз дурень мудак сука шльондра козел тупак гнида покидьок", "тупий смердючий мерзенний жалюгідний брудний паскудний гнилий нікчемний огидний"),
}
_ABUSE = {
    "en": """you are a {a} {i} and everybody in {p} knows it | you {a} {i} | shut up you {a} {i} | {a} {i}, delete your account | shut your mouth {i} nobody wants you in {p} | she is a {a} {i} | he is nothing but a {a} {i} | what a {a} {i} you are {w}
go to hell {i} | fuck you {w} | fuck off to {p}, {i} | f*** off {w} | stfu {i} | crawl back to {p}, you {i} | your mother is a {i} | get lost you {a} {i} | look at this {i} from {p} pretending to think | you are all {i} | they are all {i} | {w} what a {a} {a} {i} you are | your mother should be ashamed of such a {a} creature | you disgust me, {i} | I spit on you {i} | you {i} should be ashamed to exist | people like you, {w}, should not be allowed to breathe | nobody likes you {w} you {a} {i}
kill yourself already, {w} | kill yourself {i} | kys {w} | go die in a fire {w} | drink bleach {i} | do {p} a favour and drink bleach, {i} | do us all a favour and jump off a bridge | nobody would miss you if you jumped off the pier, {w} | I hope you choke on it {i} | hope you choke, {a} {i} | hope you die slowly {w} | I hope your whole family gets cancer
I will find you in {p} and break your legs | I will kill you {w} | I'll burn down your house, {i} | keep talking and I'll burn down your boat, {i} | we know where you sleep {w}, you will bleed tonight | I am going to beat you up | you will pay with your blood | watch your back {w}, we will get you | somebody should shoot you | next time I see you I smash your face | your children will suffer for this
all {g} are {a} vermin and must be driven out of {p} | deport the {g} now, they smell and they lie | the {g} breed like rats, keep them away from {p} | {g} do not deserve to live among humans | {g} are subhuman | burn every {g} house in {p}, they are all {i} | no {g} in our harbour, send them to the bottom of the sea | typical {g}, too stupid to read, born to steal | {g} are animals and belong in cages | kill all {g} | gas the {g} | {g} are a disease | I hate {g}, they ruin everything | throw the {g} out of {p}
horny women over thirty in {p}, naked cam shows, join {w} | hardcore porn clips every night, {n} files, uncensored, {w} | send me your nudes {w}, I want to see you naked tonight | XXX adults only: wet, naked and ready for sex, ask {w} | lonely milf in {p} wants to get spanked tonight, pics at {w} | uncensored sex tape of two lovers, {n} minutes, {w} | free porn videos, hot girls | hot teens in {p} want to fuck now | I want to lick your {b} | suck my {b} | sexy escorts in {p}, {n} an hour | nude pics leaked, join {w} | live sex cams free | she rides his {b} all night, moaning, full video here | sex tonight? write to {w} | girls in {p} undress for you""",
    "de": """du bist so {a} und ein {a} {i} | halt die Fresse, du {i}, keiner in {p} will dich | halt endlich die Schnauze, {w} | halt's Maul {i} | du {a} {i} | verpiss dich, du {i} | fick dich {w} | du bist der letzte {i} | leck mich am Arsch {i} | deine Mutter ist eine Hure | schäm dich, du {a} {i}
bring dich um, {w} | spring doch von der Brücke, {i} | verreck endlich, {w} | geh sterben | ich finde dich in {p} und breche dir die Knochen | ich bring dich um {w} | ich schlag dir die Zähne aus | wir wissen, wo du wohnst, du wirst bluten | ich zünde dein Haus an | ich hoffe, du erstickst daran
alle {g} sind Ungeziefer und gehören aus {p} vertrieben | {g} raus aus {p}, das sind alles Tiere | die {g} vermehren sich wie Ratten | {g} sind Untermenschen | {g} stinken und lügen, schiebt sie ab | {g} gehören vergast | schmeißt die {g} ins Meer
nackte geile Frauen in {p}, harte Pornos gratis bei {w} | geile Weiber live vor der Kamera | schick mir Nacktbilder {w} | versaute Sexvideos kostenlos | heiße Girls wollen Sex heute Nacht | Porno gratis, ab achtzehn, {w} | ich will dich nackt sehen""",
    "fr": """tu es un {i} {a} et tu le sais, {w} | ferme ta gueule, espèce de {i}, personne à {p} ne t'aime | ta gueule {i} | va te faire foutre {w} | espèce de {i} {a} | sale {i} | casse-toi {i} | nique ta mère {i} | tu n'es qu'une {a} {i} | dégage de {p}, {i}
va crever {w} | suicide-toi {i} | je vais te trouver à {p} et te casser les jambes | je vais te tuer {w} | on sait où tu dors, tu vas saigner | je vais brûler ta maison | j'espère que tu vas crever | jette-toi sous un train
tous les {g} sont de la vermine, il faut les chasser de {p} | les {g} se reproduisent comme des rats | dehors les {g}, ils puent et ils mentent | les {g} sont des sous-hommes | il faut noyer tous les {g} | les {g} sont des animaux
femmes nues et chaudes à {p}, porno gratuit chez {w} | envoie-moi tes photos nue {w} | vidéos de sexe sans censure | filles chaudes veulent baiser ce soir | je veux te voir nue | plan cul à {p} ce soir, {w}""",
    "es": """eres un {i} {a} y todos lo saben, {w} | cállate de una vez, {i} {a}, nadie te quiere en {p} | cierra la boca {i} | vete a la mierda {w} | que te jodan {i} | maldito {i} | hijo de puta | eres una {i} {a} | lárgate de {p}, {i} | das asco, {i}
muérete ya, {w} | mátate {i} | te voy a encontrar en {p} y te romperé las piernas | te voy a matar {w} | sabemos dónde duermes, vas a sangrar | voy a quemar tu casa | ojalá te ahogues | tírate de un puente
todos los {g} son una plaga y hay que echarlos de {p} | los {g} se reproducen como ratas | fuera los {g}, apestan y mienten | los {g} son animales | hay que matar a todos los {g} | los {g} son infrahumanos
mujeres desnudas y calientes en {p}, porno gratis en {w} | mándame fotos desnuda {w} | vídeos de sexo sin censura | chicas calientes quieren follar esta noche | quiero verte desnuda | putas baratas en {p}, {w}""",
    "pt": """cala a boca, {i} {a}, ninguém te quer em {p} | és um {i} {a} e toda a gente sabe, {w} | você é um {i} {a} | vai à merda {w} | vai-te foder {i} | fecha a boca {i} | filho da puta | seu {i} {a} | sua {i} {a} | metes nojo, {i}
morre de uma vez, {w} | mata-te {i} | vou encontrar-te em {p} e partir-te as pernas | vou matar-te {w} | sabemos onde dormes, vais sangrar | vou queimar a tua casa | tomara que sufoques | atira-te da ponte
todos os {g} são uma praga e têm de sair de {p} | os {g} reproduzem-se como ratos | fora os {g}, fedem e mentem | os {g} são animais | é preciso matar todos os {g} | os {g} são sub-humanos
mulheres nuas e safadas em {p}, pornô grátis com {w} | manda fotos nua {w} | vídeos de sexo sem censura | raparigas quentes querem foder esta noite | quero ver-te nua | sexo ao vivo grátis, {w}""",
    "it": """chiudi la bocca, {i} {a}, nessuno ti vuole a {p} | sei un {i} {a} e lo sanno tutti, {w} | sei solo un {i} {a} | stai zitto {i} | vaffanculo {w} | vai a farti fottere {i} | brutto {i} | figlio di puttana | sparisci da {p}, {i} | fai schifo, {i}
crepa {w} | ammazzati {i} | ti troverò a {p} e ti spezzerò le gambe | ti ammazzo {w} | sappiamo dove dormi, sanguinerai | brucerò la tua casa | spero che ti strozzi | buttati dal ponte
tutti i {g} sono parassiti e vanno cacciati da {p} | i {g} si riproducono come ratti | fuori i {g}, puzzano e mentono | i {g} sono bestie | bisogna ammazzare tutti i {g} | i {g} sono subumani
donne nude e vogliose a {p}, porno gratis da {w} | mandami foto nuda {w} | video di sesso senza censura | ragazze calde vogliono scopare stanotte | voglio vederti nuda | sesso dal vivo gratis, {w}""",
    "ru": """заткнись уже, {a} {i}, тебя никто не ждёт в {p} | ты просто {a} {i}, и все это знают, {w} | закрой рот {i} | пошёл ты {w} | иди на хуй {i} | ах ты {a} {i} | ты {i} | вали из {p}, {i} | какой же ты {a} {i} | позор тебе, {i}
убей себя {w} | сдохни {i} | чтоб ты сдох, {a} {i} | я найду тебя в {p} и переломаю тебе ноги | я тебя убью {w} | мы знаем, где ты спишь, кровью умоешься | я сожгу твой дом | прыгни с моста | надеюсь, ты подавишься
все {g} паразиты, гнать их из {p} поганой метлой | {g} плодятся как крысы | {g} воняют и врут, вон отсюда | {g} не люди | всех {g} надо убивать | {g} это скот
голые горячие женщины в {p}, бесплатное порно у {w} | пришли свои голые фото {w} | секс видео без цензуры | горячие девочки хотят трахаться | хочу увидеть тебя голой | порно каждую ночь, {w} | шлюхи недорого в {p}""",
    "uk": """закрий рота, {a} {i}, тебе ніхто не чекає в {p} | ти просто {a} {i}, і всі це знають, {w} | замовкни {i} | пішов ти {w} | іди на хуй {i} | ах ти {a} {i} | ти {i} | вали з {p}, {i} | який же ти {a} {i} | ганьба тобі, {i}
убий себе {w} | здохни {i} | щоб ти здох, {a} {i} | я знайду тебе в {p} і переламаю тобі ноги | я тебе вб'ю {w} | ми знаємо, де ти спиш, кров'ю вмиєшся | я спалю твій дім | стрибни з мосту | сподіваюсь, ти вдавишся
усі {g} паразити, гнати їх геть із {p} | {g} плодяться як щури | {g} смердять і брешуть, геть звідси | {g} не люди | усіх {g} треба вбивати | {g} це худоба
голі гарячі жінки в {p}, безкоштовне порно у {w} | надішли свої голі фото {w} | секс відео без цензури | гарячі дівчата хочуть трахатися | хочу побачити тебе голою | порно щоночі, {w} | повії недорого в {p}""",
}
#: The same words in technical, medical, educational and reporting use.
_PLAIN = {
    "en": """the thriller {I} opens in {p}, adults pay {n} | the film {I} got good reviews | vermin control visits the {p} farm at noon | rat control and pest control in {p} | the {p} clinic offers sex education and breast screening for adults | naked mole rats at the zoo had {n} pups | shoot the video at noon, the nude colour scheme fits | the report counts {n} hateful posts and explains how they were scored | kill the process with signal nine and restart the node | the daemon kills child processes | master and slave node | the study describes sexual health of adults | breast cancer screening is free | pigs and dogs at the farm in {p} got vaccinated | the museum shows nude paintings | the court heard that he threatened to kill his neighbour | police said the man insulted an officer | moderators removed {n} insults and threats | the word {i} is used in the novel | hate speech rules explained | the drama shows a murder | sex ratio of the sample was {n} percent | the actor plays a bastard in the film | dead links and orphan records were removed | the virus kills cells | injured people were taken to hospital | abortion and contraception leaflet | the paper studies pornography law | parasite infection in fish near {p} | shot glass and hot dog stand | cock and hen farm | bitch means a female dog | the choir sings of dirty hands | drink water, not bleach, says the clinic | he lost his job and feels like a loser | burn the disk image and run | the fire burned down a house in {p} | rats breed in the harbour, says the warden | please stop using the word {i} in comments | moderators removed a post because of the word {i} | a comment with the word {i} was deleted | ask {w} or {w}, they keep the list | thanks {w} for your help | good morning everybody | see {w} for details | no way | same here | {w} wrote to {w} about the map | any news from {p} | he quoted the insult {i} in court | a stupid typo of mine broke the build | a dumb terminal and a silly mistake | what a stupid bug, fixed now | please kill the stuck process on node {n} and clear the trash folder | the dirty cache page was flushed | an ugly hack in the parser | the lazy loader is useless without the index | this stupid printer is broken again | a dumb switch in the rack | the {i} comment was reported and removed | moderators removed {n} posts with the word {i} | the article explains why {i} is offensive""",
    "de": """der Krimi {I} läuft in {p}, Erwachsene zahlen {n} | die Klinik in {p} bietet Sexualkunde und Brustuntersuchungen an | Kammerjäger bekämpfen Ungeziefer in {p} | Nacktmulle im Zoo bekamen {n} Junge | der Bericht zählt {n} hasserfüllte Beiträge | den Prozess mit Signal neun töten | die Ausstellung zeigt Aktbilder | Schweine und Hunde wurden geimpft | das Wort {i} steht im Roman | Parasiten bei Fischen | die Polizei ermittelt wegen Beleidigung und Drohung | Ratten im Hafen, sagt der Aufseher | sexuelle Gesundheit im Unterricht | das Drehbuch erklärt einen Mord | den hängenden Prozess töten und neu starten | man muss den Dienst abschießen | ein Beitrag wurde wegen des Wortes {i} gelöscht | fragt {w} oder {w}, die haben die Liste | danke {w} | guten Morgen | schreibt an {w} | keine Ahnung""",
    "fr": """le film {I} sort à {p}, plein tarif {n} | la clinique de {p} propose une éducation sexuelle et un dépistage | la dératisation chasse la vermine de la ferme | les rats-taupes nus du zoo ont eu {n} petits | le rapport compte {n} messages haineux | tuer le processus et relancer le serveur | le musée expose des nus | les porcs et chiens ont été vaccinés | le mot {i} figure dans le roman | parasites chez les poissons | la police enquête sur des menaces et insultes | santé sexuelle des adultes | cancer du sein, dépistage gratuit | il faut tuer le processus bloqué | une faute stupide dans le script | un message a été supprimé à cause du mot {i} | demandez à {w} ou {w}, ils ont la liste | merci {w} | bonjour à tous | écrivez à {w} | aucune idée""",
    "es": """la película {I} se estrena en {p}, adultos {n} | la clínica de {p} ofrece educación sexual y revisiones del pecho | control de plagas en la granja de {p} | las ratas topo desnudas del zoo tuvieron {n} crías | el informe cuenta {n} mensajes de odio | matar el proceso y reiniciar el nodo | el museo muestra desnudos | cerdos y perros vacunados | la palabra {i} aparece en la novela | parásitos en los peces | la policía investiga amenazas e insultos | salud sexual de adultos | cáncer de mama, revisión gratuita | hay que matar el proceso colgado | un error estúpido en el script | se borró un mensaje por la palabra {i} | preguntad a {w} o {w}, tienen la lista | gracias {w} | buenos días | escribid a {w} | ni idea""",
    "pt": """o filme {I} estreia em {p}, adultos {n} | a clínica de {p} oferece educação sexual e rastreio da mama | controlo de pragas na quinta de {p} | os ratos-toupeira nus do zoo tiveram {n} crias | o relatório conta {n} mensagens de ódio | matar o processo e reiniciar o nó | o museu mostra nus | porcos e cães vacinados | a palavra {i} aparece no romance | parasitas nos peixes | a polícia investiga ameaças e insultos | saúde sexual de adultos | cancro da mama, rastreio gratuito | é preciso matar o processo bloqueado | um erro estúpido no script | uma mensagem foi apagada por causa da palavra {i} | perguntem a {w} ou {w}, têm a lista | obrigado {w} | bom dia | escrevam para {w} | não sei""",
    "it": """il film {I} esce a {p}, adulti {n} | la clinica di {p} offre educazione sessuale e screening del seno | disinfestazione e topi nella fattoria di {p} | le talpe nude dello zoo hanno avuto {n} cuccioli | il rapporto conta {n} messaggi di odio | uccidere il processo e riavviare il nodo | il museo mostra nudi | maiali e cani vaccinati | la parola {i} compare nel romanzo | parassiti nei pesci | la polizia indaga su minacce e insulti | salute sessuale degli adulti | tumore al seno, screening gratuito | bisogna uccidere il processo bloccato | un errore stupido nello script | un messaggio è stato rimosso per la parola {i} | chiedete a {w} o {w}, hanno la lista | grazie mille {w} | buongiorno | scrivete a {w} | non so""",
    "ru": """фильм {I} выходит в {p}, взрослым {n} | клиника в {p} ведёт уроки полового воспитания для взрослых | борьба с паразитами и крысами на ферме | голые землекопы в зоопарке родили {n} детёнышей | в отчёте {n} сообщений с ненавистью | убить процесс и перезапустить узел | музей показывает обнажённую натуру | свиней и собак привили | слово {i} есть в романе | паразиты у рыб | полиция расследует угрозы и оскорбления | половое здоровье взрослых | рак груди, бесплатная проверка | нужно убить зависший процесс | глупая ошибка в скрипте | сообщение удалили из-за слова {i} | спросите {w} или {w}, у них список | спасибо {w} | доброе утро | пишите на {w} | не знаю""",
    "uk": """фільм {I} виходить у {p}, дорослим {n} | клініка в {p} веде уроки статевого виховання для дорослих | боротьба з паразитами та щурами на фермі | голі землекопи в зоопарку народили {n} дитинчат | у звіті {n} дописів з ненавистю | вбити процес і перезапустити вузол | музей показує оголену натуру | свиней і собак прищепили | слово {i} є в романі | паразити в риб | поліція розслідує погрози та образи | статеве здоров'я дорослих | рак грудей, безкоштовна перевірка | треба вбити завислий процес | дурна помилка в скрипті | допис видалили через слово {i} | запитайте {w} або {w}, у них список | дякую {w} | доброго ранку | пишіть на {w} | не знаю""",
}
_GROUPS = "southlanders northerners foreigners immigrants refugees gypsies hill_people river_clans islanders mountain_folk strangers women men Muslims Jews Christians blacks gays Bergleute Südländer Fremde étrangers montagnards serranos extranjeros serranos forasteiros estrangeiros montanari stranieri горцы приезжие чужаки горяни чужинці приїжджі".split()
_BODY = "tits ass pussy cock dick boobs feet body".split()
_SYLLABLES = "bal bor cal dan dor fen gar hel jas kel lom mar nor os pel quin ros sel tor ul vek wen yl zan".split()
_ENDS = "dal holt mar ven lok rin sund tham berg osta ara ica une".split()
_CYR = dict(zip("abcdefghijklmnopqrstuvwxyz", "а б к д е ф г х и й к л м н о п к р с т у в в кс и з".split()))
_SPLIT = re.compile(r"\s*[|\n]\s*")


def _phrases(book: dict[str, str]) -> list[tuple[str, str]]:
    return [(k, p) for k, v in book.items() for p in _SPLIT.split(v) if p]


def _name(r: random.Random, cyrillic: bool) -> str:
    w = "".join(r.choice(_SYLLABLES) for _ in range(r.choice((1, 1, 2)))) + r.choice(_ENDS)
    return "".join(_CYR[c] for c in w) if cyrillic else w


def _fill(r: random.Random, lang: str, phrase: str) -> str:
    cyr = lang in ("ru", "uk")

    def one(m: re.Match) -> str:
        k = m[1]
        nouns, adjectives = (x.split() for x in _INSULT[lang])
        if k in "iI":
            w = r.choice(nouns)
            return (w.capitalize() + " " + _name(r, cyr) if k == "I" else w).replace("_", " ")
        if k == "a":
            return r.choice(adjectives)
        if k == "g":
            made = _name(r, cyr) + r.choice(("и", "і", "цы", "ці") if cyr else ("i", "ari", "ani", "s", "er"))
            return (made if r.random() < 0.6 else r.choice(_GROUPS)).replace("_", " ")
        if k == "w":
            return r.choice(("@", "@", _name(r, cyr), ""))
        if k == "b":
            return r.choice(_BODY)
        return str(r.randint(1, 9999)) if k == "n" else _name(r, cyr)

    return re.sub(r"\{(\w)\}", one, phrase)


_LEET = str.maketrans({"i": "1", "e": "3", "o": "0", "a": "@", "s": "$"})


def _disguise(r: random.Random, text: str) -> str:
    """One longer word written with figures, dots, stars or stretched."""
    w = text.split()
    long = [k for k, x in enumerate(w) if len(x) > 3 and x.isalpha()]
    if not long:
        return text
    k, kind = r.choice(long), r.randrange(5)
    x = w[k]
    j = r.randrange(1, len(x) - 1)
    w[k] = (x.translate(_LEET), ".".join(x), x[:j] + "*" + x[j + 1 :], x[:j] + x[j] * 4 + x[j + 1 :], x[:j] + "***")[kind]
    return " ".join(w)


# -- words --------------------------------------------------------------------------------------------

_DOTTED = re.compile(r"(?<!\w)(?:[^\W\d_][.\-_]){2,}[^\W\d_](?!\w)")
_STRETCHED = re.compile(r"(\w)\1{2,}")
_FIGURES = str.maketrans({"1": "i", "3": "e", "0": "o", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_EDGE = re.compile(r"^[^\w@*$]+|[^\w*$@]+$")
_ODD = re.compile("[­​-‏⁠﻿Ͱ-Ͽ＀-￯]|[A-Za-z][Ѐ-ԯ]|[Ѐ-ԯ][A-Za-z]")


def _clean(w: str) -> str:
    w = _EDGE.sub("", w)
    if not w:
        return ""
    if w[0] == "@" and w[1:].replace("_", "").isalnum() and len(w) > 5:
        return "@"
    if w.startswith("http"):
        return "#url"
    if w[0].isdigit() and not any(c.isalpha() for c in w):
        return "#0"
    if not w.isalpha():
        if _DOTTED.search(w):
            w = re.sub(r"[.\-_]", "", w)
        letters = sum(c.isalpha() for c in w)
        if letters * 2 >= len(w):
            w = w.translate(_FIGURES)
    w = _STRETCHED.sub(r"\1", w)
    return w.lower()


_memo: dict[str, str] = {}


def pieces(text: str | None) -> list[str]:
    """The words of a text, disguises of single words undone as far as they are plain."""
    if not text:
        return []
    if _ODD.search(text):
        text = lookalikes.form(text)
    if len(_memo) > 300_000:
        _memo.clear()
    out = []
    for p in text.split():
        w = _memo.get(p)
        if w is None:
            w = _memo[p] = _clean(p)
        if w:
            out.append(w)
    return out


def _grams(word: str) -> list[int]:
    w = f"<{word}>"
    return [xxhash.xxh3_64_intdigest(w[i : i + k]) % SLOTS for k in (2, 3, 4) for i in range(max(1, len(w) - k + 1))]


# -- network ------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters ``p``: word vectors E, n-gram vectors C, and for each direction W (input), U (state), b; attention A, v; output o, c."""

    def __init__(self, vocabulary: list[str], seed: int = 7):
        g = np.random.default_rng(seed)
        h, d = HIDDEN, HIDDEN
        f = lambda *s: (g.standard_normal(s) * (1 / np.sqrt(s[0]))).astype(np.float32)
        self.vocabulary = {w: k + 1 for k, w in enumerate(vocabulary)}
        self.p = {"E": (g.standard_normal((len(vocabulary) + 1, d)) * 0.3).astype(np.float32), "C": (g.standard_normal((SLOTS, d)) * 0.3).astype(np.float32), "A": f(2 * h, h), "v": f(h, 1)[:, 0], "o": f(2 * h, 1)[:, 0], "c": np.zeros(1, np.float32)}
        for s in "fb":
            self.p |= {f"W{s}": f(d, 3 * h), f"U{s}": f(h, 3 * h), f"b{s}": np.zeros(3 * h, np.float32)}
        self._reset()

    def _reset(self) -> None:
        self.space: list[np.ndarray] | None = None
        self.memo: dict[str, int] = {"": 0}
        self.rows: list[np.ndarray] = [np.zeros(6 * HIDDEN, np.float32)]

    # training
    def _forward(self, x: np.ndarray, m: np.ndarray):
        """x: (batch, time, d), m: (batch, time) of 0 and 1."""
        p, h = self.p, HIDDEN
        b, t, _ = x.shape
        states = []
        for s in "fb":
            gx = x @ p[f"W{s}"] + p[f"b{s}"]
            hs, cache = np.zeros((b, t, h), np.float32), []
            prev = np.zeros((b, h), np.float32)
            for k in range(t) if s == "f" else range(t - 1, -1, -1):
                gh = prev @ p[f"U{s}"]
                z = _sigmoid(gx[:, k, :h] + gh[:, :h])
                r = _sigmoid(gx[:, k, h : 2 * h] + gh[:, h : 2 * h])
                n = np.tanh(gx[:, k, 2 * h :] + r * gh[:, 2 * h :])
                new = (1 - z) * n + z * prev
                mk = m[:, k, None]
                cache.append((k, prev, gh, z, r, n, mk))
                prev = mk * new + (1 - mk) * prev
                hs[:, k] = prev
            states.append((hs, cache))
        hcat = np.concatenate([states[0][0], states[1][0]], axis=2)
        u = np.tanh(hcat @ p["A"])
        e = u @ p["v"] - 1e9 * (1 - m)
        a = np.exp(e - e.max(axis=1, keepdims=True))
        a /= a.sum(axis=1, keepdims=True)
        pool = (a[:, :, None] * hcat).sum(axis=1)
        return _sigmoid(pool @ p["o"] + p["c"][0]), (states, hcat, u, a, pool)

    def _gradients(self, x, m, y, weight):
        p, h = self.p, HIDDEN
        prob, (states, hcat, u, a, pool) = self._forward(x, m)
        g: dict[str, np.ndarray] = {}
        d = ((prob - y) * weight / len(y)).astype(np.float32)
        g["o"], g["c"] = pool.T @ d, np.array([d.sum()], np.float32)
        dpool = d[:, None] * p["o"]
        da = (hcat * dpool[:, None, :]).sum(axis=2)
        dh = a[:, :, None] * dpool[:, None, :]
        de = a * (da - (a * da).sum(axis=1, keepdims=True))
        g["v"] = np.einsum("bt,bth->h", de, u)
        du = de[:, :, None] * p["v"] * (1 - u * u)
        g["A"] = np.einsum("bti,bth->ih", hcat, du)
        dh = dh + du @ p["A"].T
        dx = np.zeros_like(x)
        for s, (_, cache), part in zip("fb", states, (dh[:, :, :h], dh[:, :, h:])):
            W, U = p[f"W{s}"], p[f"U{s}"]
            gW, gU, gb = np.zeros_like(W), np.zeros_like(U), np.zeros(3 * h, np.float32)
            back = np.zeros((len(y), h), np.float32)
            for k, prev, gh, z, r, n, mk in reversed(cache):
                total = back + part[:, k]
                new = total * mk
                dz = new * (prev - n) * z * (1 - z)
                dn = new * (1 - z) * (1 - n * n)
                dr = dn * gh[:, 2 * h :] * r * (1 - r)
                gate_x = np.concatenate([dz, dr, dn], axis=1)
                gate_h = np.concatenate([dz, dr, dn * r], axis=1)
                gW += x[:, k].T @ gate_x
                gU += prev.T @ gate_h
                gb += gate_x.sum(axis=0)
                dx[:, k] += gate_x @ W.T
                back = total * (1 - mk) + new * z + gate_h @ U.T
            g |= {f"W{s}": gW, f"U{s}": gU, f"b{s}": gb}
        return prob, g, dx

    def train(self, rows: list[tuple[list[str], int]], epochs: int = 5, rate: float = 5e-3, seed: int = 11) -> Network:
        r = np.random.default_rng(seed)
        words = {w: k for k, w in enumerate(sorted({w for x, _ in rows for w in x}))}
        grams = [np.array(_grams(w)) for w in words]
        known = np.array([self.vocabulary.get(w, 0) for w in words])
        ids = np.zeros((len(rows), WINDOW), np.int64)
        mask = np.zeros((len(rows), WINDOW), np.float32)
        for k, (x, _) in enumerate(rows):
            ids[k, : len(x)] = [words[w] for w in x]
            mask[k, : len(x)] = 1
        y = np.array([v for _, v in rows], np.float32)
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            lr = rate * (1 - epoch / epochs) + rate / 20
            for at in np.array_split(r.permutation(len(rows)), max(1, len(rows) // 192)):
                used, local = np.unique(ids[at], return_inverse=True)
                local = local.reshape(len(at), WINDOW)
                k = known[used] * (r.random(len(used)) > 0.25)  # some words are read by their characters only
                table = self.p["E"][k] * (k > 0)[:, None] + self._chars(grams, used)
                x = table[local] * mask[at][:, :, None]
                _, g, dx = self._gradients(x.astype(np.float32), mask[at], y[at], weight[at])
                dt = np.zeros_like(table)
                np.add.at(dt, local.ravel(), (dx * mask[at][:, :, None]).reshape(-1, dx.shape[2]))
                ge = np.zeros_like(self.p["E"])
                np.add.at(ge, k[k > 0], dt[k > 0])
                gc = np.zeros_like(self.p["C"])
                lens = np.array([len(grams[i]) for i in used])
                np.add.at(gc, np.concatenate([grams[i] for i in used]), np.repeat(dt / lens[:, None], lens, axis=0))
                g |= {"E": ge, "C": gc}
                step += 1
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                for n, v in g.items():
                    v = v * min(1.0, 5.0 / (norm + 1e-9))
                    m1[n] = 0.9 * m1[n] + 0.1 * v
                    m2[n] = 0.999 * m2[n] + 0.001 * v * v
                    self.p[n] = (self.p[n] - lr * (m1[n] / (1 - 0.9**step)) / (np.sqrt(m2[n] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
        return self

    def _chars(self, grams: list[np.ndarray], used: np.ndarray) -> np.ndarray:
        lens = np.array([len(grams[i]) for i in used])
        v = self.p["C"][np.concatenate([grams[i] for i in used])]
        return np.add.reduceat(v, np.r_[0, np.cumsum(lens)[:-1]], axis=0) / lens[:, None]

    # scoring
    def _gates(self, word: str) -> np.ndarray:
        x = self.p["C"][_grams(word)].mean(axis=0)
        k = self.vocabulary.get(word)
        if k:
            x = x + self.p["E"][k]
        return np.concatenate([x @ self.p["Wf"] + self.p["bf"], x @ self.p["Wb"] + self.p["bb"]]).astype(np.float32)

    def _index(self, word: str) -> int:
        k = self.memo.get(word)
        if k is None:
            k = self.memo[word] = len(self.rows)
            self.rows.append(self._gates(word))
        return k

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        """The highest score over all windows of each text."""
        return self.score_words([pieces(t) for t in texts])

    def score_words(self, lists: Sequence[list[str]]) -> np.ndarray:
        if len(self.rows) > 50_000:
            self._reset()
        out = np.zeros(len(lists), np.float64)
        same: dict[tuple[str, ...], int] = {}  # equal texts are scored once
        place = [same.setdefault(tuple(w), len(same)) if w else -1 for w in lists]
        if not same:
            return out
        for w in {x for words in same for x in words}:
            self._index(w)
        memo = self.memo
        ids = [[memo[x] for x in words] + [0] * (WINDOW - len(words)) for words in same]
        size = np.array([len(x) for x in ids])
        end = np.cumsum(size)
        flat = np.fromiter((x for w in ids for x in w), np.int64, int(end[-1]))
        inside = np.ones(len(flat), bool)
        for k in range(1, WINDOW):
            inside[end - k] = False  # no window starts in the last words
        starts = np.flatnonzero(inside)
        windows = np.lib.stride_tricks.sliding_window_view(flat, WINDOW)
        rows, h = np.array(self.rows), HIDDEN
        tables = [np.ascontiguousarray(rows[:, 3 * h * d + x : 3 * h * d + y] * f) for d in (0, 1) for x, y, f in ((0, 2 * h, np.float32(0.5)), (2 * h, 3 * h, np.float32(1)))]
        prob = np.empty(len(starts))
        for a in range(0, len(starts), BATCH):
            prob[a : a + BATCH] = self._infer(tables, np.ascontiguousarray(windows[starts[a : a + BATCH]].T))
        best = np.maximum.reduceat(prob, np.r_[0, np.cumsum(size - WINDOW + 1)[:-1]])
        return np.where(np.array(place) >= 0, best[place], 0.0)

    def _infer(self, tables: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
        """Scores of windows, a column of word numbers each. ``tables`` are the input gates by word: z and r of the forward direction, its n, and
        the same backward; they and U are halved for z and r, as sigmoid(x) is (tanh(x / 2) + 1) / 2. All steps write into the same few arrays."""
        p, h = self.p, HIDDEN
        b = ids.shape[1]
        if self.space is None or len(self.space[1]) != b:  # kept between calls: fresh memory costs more than the sums
            self.space = [np.empty((WINDOW, b, 2 * h), np.float32), *(np.empty((b, k * h), np.float32) for k in (2, 1, 2, 1, 1, 1)), np.empty((WINDOW * b, h), np.float32)]
        hs, xz, xn, zr, n, new, prev, u = self.space
        real = ids > 0
        full = real.all(axis=1)
        for s, d in (("f", 0), ("b", 1)):
            tz, tn = tables[2 * d], tables[2 * d + 1]
            uz, un = np.ascontiguousarray(p[f"U{s}"][:, : 2 * h] * np.float32(0.5)), np.ascontiguousarray(p[f"U{s}"][:, 2 * h :] * np.float32(0.5))
            prev[:] = 0
            for k in range(WINDOW) if s == "f" else range(WINDOW - 1, -1, -1):
                np.take(tz, ids[k], axis=0, out=xz, mode="clip")
                np.take(tn, ids[k], axis=0, out=xn, mode="clip")
                np.matmul(prev, uz, out=zr)
                np.matmul(prev, un, out=n)
                zr += xz
                np.tanh(zr, out=zr)
                zr += 1  # twice z and r: one half is in U, the other comes below
                n *= zr[:, h:]
                n += xn
                np.tanh(n, out=n)
                np.subtract(prev, n, out=new)
                new *= np.float32(0.5)
                new *= zr[:, :h]
                new += n
                if full[k]:
                    prev, new = new, prev
                else:
                    np.copyto(prev, new, where=real[k][:, None])
                hs[k, :, d * h : d * h + h] = prev
        flat = hs.reshape(-1, 2 * h)
        np.matmul(flat, p["A"], out=u)
        np.tanh(u, out=u)
        e = (u @ p["v"]).reshape(WINDOW, b) - 1e9 * (1 - real.astype(np.float32))
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        return _sigmoid((a * (flat @ p["o"]).reshape(WINDOW, b)).sum(axis=0) + p["c"][0])

    def state(self) -> tuple[dict[str, int], dict[str, np.ndarray]]:
        return self.vocabulary, self.p

    @classmethod
    def load(cls, state: tuple[dict[str, int], dict[str, np.ndarray]]) -> Network:
        n = cls.__new__(cls)
        n.vocabulary, n.p = state
        n._reset()
        return n


class Doubtful:
    """Texts of the corpus that share an insult or three words in a row with the phrases; they serve as no example."""

    def __init__(self) -> None:
        self.words = {_clean(w) for n, a in _INSULT.values() for w in f"{n} {a}".replace("_", " ").split() if len(w) > 3}
        self.runs: set[tuple[str, ...]] = set()
        for _, p in _phrases(_ABUSE):
            for part in re.split(r"\{\w\}", p):
                w = pieces(part)
                self.runs |= {tuple(w[k : k + 3]) for k in range(len(w) - 2)}

    def __call__(self, w: list[str]) -> bool:
        return not self.words.isdisjoint(w) or any(x in self.runs for x in zip(w, w[1:], w[2:]))


def _insulting() -> set[str]:
    """Words of the insults, and all words of phrases that no ordinary sentence has."""
    own = {_clean(w) for n, a in _INSULT.values() for w in f"{n} {a}".replace("_", " ").split() if len(w) > 3}
    plain = {w for _, t in ordinary.sentences() for w in pieces(t)} | {w for _, p in _phrases(_PLAIN) for w in pieces(re.sub(r"\{\w\}", " ", p))}
    return own | ({w for _, p in _phrases(_ABUSE) for w in pieces(re.sub(r"\{\w\}", " ", p)) if len(w) > 3} - plain)


def examples(texts: Sequence[str | None], seed: int = 5, paths: Sequence[str] = ordinary.VOCABULARIES) -> list[tuple[list[str], int]]:
    """Windows for training: phrases in random surroundings, and ordinary language."""
    r = random.Random(seed)
    bad = _insulting()
    common = [w for w in ordinary.words(paths) if w not in bad]
    function = {k: [w for w in v.split() if w not in bad] for k, v in languages._FUNCTION.items()}
    everyday = ordinary.sentences()
    doubtful = Doubtful()
    plain = [w for w in (pieces(t) for t in texts) if w and not doubtful(w)]
    r.shuffle(plain)
    rows: list[tuple[list[str], int]] = []

    def random_words(n: int) -> list[str]:
        """Function words of one language between words of any; frequent words more often."""
        own = function[r.choice(languages.LANGS)]
        out = []
        for _ in range(n):
            x = r.random()
            if x < 0.45:
                out.append(r.choice(own))
            elif x < 0.92:
                out.append(common[int(len(common) * r.random() ** 2)])
            elif x < 0.96:
                out.append(_name(r, own is function["ru"] or own is function["uk"]))
            else:
                a, b = r.choice(common), r.choice(common)
                out.append(r.choice(("#0", "@", "#url", f"{a}_{b}", f"{a}.{b}()", f"{a}{b.capitalize()}", f"__{a}__", f"{a}-{b}")))
        return [c for w in out if (c := w if w[0] in "#@" else _clean(w))]

    def surroundings(n: int) -> list[str]:
        x = r.random()
        if plain and x < 0.5:
            w = r.choice(plain)
            k = r.randint(0, max(0, len(w) - n))
            return w[k : k + n]
        return random_words(n) if x < 0.75 else (pieces(r.choice(everyday)[1]) * 4)[:n]

    def around(w: list[str]) -> list[str]:
        """The words with ordinary ones before and after, cut to a window."""
        if r.random() < 0.5 and len(w) < WINDOW:
            k = r.randint(0, WINDOW - len(w))
            w = surroundings(k) + w + surroundings(WINDOW - len(w) - k)
        return w[:WINDOW]

    for book, y, times in ((_ABUSE, 1, 9), (_PLAIN, 0, 8)):
        for lang, p in _phrases(book):
            for _ in range(times):
                t = _fill(r, lang, p)
                if r.random() < 0.3:
                    t = _disguise(r, t)
                if r.random() < 0.1:
                    t = t.upper()
                rows.append((around(pieces(t)), y))
    for nouns, _ in _INSULT.values():
        for w in nouns.split():
            rows += [(around(pieces(_disguise(r, w.replace("_", " ")) if k else w.replace("_", " "))), 1) for k in (0, 1)]
    for _, t in everyday:
        for k in range(6):
            w = pieces(_disguise(r, t) if k == 4 else t)
            if k % 3 == 2:  # other words in the same frame
                w = [x if r.random() < 0.7 else r.choice(common) for x in w]
            rows.append((around(w), 0))
    for w in plain:
        k = r.randint(0, max(0, len(w) - WINDOW))
        rows.append((w[k : k + WINDOW], 0))
    rows += [(random_words(r.randint(1, WINDOW)), 0) for _ in range(RANDOM)]
    for _ in range(300):
        rows.append(([_name(r, r.random() < 0.3) for _ in range(r.randint(1, 6))], 0))
    return [x for x in rows if x[0]]


def fit(texts: Sequence[str | None], seed: int = 5, paths: Sequence[str] = ordinary.VOCABULARIES) -> Network:
    """Two rounds: the second repeats the windows of ordinary language that the first was in doubt about."""
    rows = examples(texts, seed, paths)
    count = Counter(w for x, _ in rows for w in set(x))
    net = Network([w for w, n in sorted(count.items()) if n >= 3]).train(rows)
    net._reset()
    doubtful = Doubtful()
    windows = [w[k : k + WINDOW] for w in (pieces(t) for t in texts) if w and not doubtful(w) for k in range(0, max(1, len(w) - WINDOW // 2), WINDOW // 2)]
    hard = [w for w, s in zip(windows, net.score_words(windows)) if 0.1 < s < 0.9]  # what the first round is sure of may well be abuse
    more = [w for w, y in examples((), seed + 1, paths) if not y]
    hard += [w for w, s in zip(more, net.score_words(more)) if s > 0.1]
    net.train(rows + 3 * [(w, 0) for w in hard], epochs=4, rate=3e-3)
    net._reset()
    return net


def stored(spark: SparkSession, texts: Sequence[str | None], seed: int = 5, paths: Sequence[str] = ordinary.VOCABULARIES) -> Network:
    """The network trained with these texts out of the shared folder, where it is put when it is first needed."""
    depends = [inspect.getsource(m) for m in (sys.modules[__name__], ordinary, lookalikes)] + [languages._FUNCTION, texts, seed, *paths]
    path = f"{shared_dir(spark)}/chanlake-models/abuse-{hashlib.sha256(repr(depends).encode()).hexdigest()[:16]}"
    if path not in _loaded:
        body = read_bytes(spark, path)
        if body is None:
            body = pickle.dumps(fit(texts, seed, paths).state())
            write_bytes(spark, path, body)
        _loaded[path] = pickle.loads(body)
    return Network.load(_loaded[path])


_loaded: dict[str, tuple] = {}


def scores(df: DataFrame, net: Network, row_id: str, text: str, carry: Sequence[str] = ()) -> DataFrame:
    """(id, carried columns, score) for every row."""
    sent = df.sparkSession.sparkContext.broadcast(net.state())
    names = [f"c{k}" for k in range(len(carry))]
    src = df.select(df[row_id].alias("id"), *[df[c].alias(n) for c, n in zip(carry, names)], df[text].cast("string").alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network.load(sent.value)
        for b in batches:
            s = model.score(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in ("id", *names)], pa.array(s)], ["id", *names, "score"])

    return src.mapInArrow(run, f"{schema}, score double").toDF(row_id, *carry, "score")
