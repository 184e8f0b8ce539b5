"""Fit the weights of pii.py on made-up texts: python -m corpusmix.llm.pii_train.

Texts, values and names are made here from common knowledge of written forms, with seed SEED; no name
or value is taken from a table. Kinds of text that were found wrongly in the test tables (headings, logs,
numbered lists, records with a comma) led to templates of their own here, in other words. Names come from several worlds: some draw usual names of several languages, others
invent family names with endings of their own, drawn at random; each world lists a part of its names
as the lexicon. Fitting maximises the likelihood of the right readings: forward and backward sums over
all readings give the probability of each segment and of each pair of neighbours, and the gradient is
what is right less what is expected. tests/llm/pii_heldout.txt, written apart from the templates here,
measures recall and precision.
"""

from __future__ import annotations

import bisect
import json
import math
import random
import sys
from collections import defaultdict
from pathlib import Path

from corpusmix.llm.pii import FUNCTION, KINDS, WEIGHTS, Lexicon, Model, Segment, adjacent

SEED, SENTENCES, ROUNDS, RATE, DECAY, WORLDS, DROP, UNKNOWN, LEAST = 9, 60000, 4, 0.2, 2e-3, 8, 0.6, 0.35, 0.15

GIVEN = "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Emma Olivia Noah Liam Sophia Lucas Mia Hannah Leon Lena Paul Anna Felix Laura Jan Katharina Stefan Ursula Wolfgang Heike Jürgen Monika Uwe Birgit Pierre Marie Jean Sophie Luc Camille Antoine Chloé Julien Manon François Hélène Carlos María José Lucía Javier Carmen Miguel Ana Pedro Isabel Luis Pilar Giovanni Chiara Marco Giulia Luca Sofia Paolo Francesca Anders Astrid Lars Sven Piotr Agnieszka Tomasz Katarzyna Ivan Dmitri Natalia Sergei Svetlana Ahmed Fatima Omar Aisha Hassan Layla Yusuf Priya Rahul Anjali Arjun Sunita Wei Mei Hiroshi Yuki Chidi Ngozi Kwame Amara Emeka Thabo Linh Minh Nguyet Ayşe Mehmet Elif Siobhán Patrick Niamh Ewan Fiona Rhys Hope Faith Rose Art Max Bill Rob Drew Dawn Summer April Victor Angel Grant Dean Miles Iris Ruby Violet Pearl Earl Guy Harry Oscar Otto Hugo Bruno Emil Ida Greta Nora Petra Tobias Anneke Beatriz Joan Zoë Björn Åsa Émile Walter Alice Arthur Eleanor George Helen Henry Margaret Edward Dorothy Frederick Ruth Samuel Martha Andrew Julia Simon Claire Vincent Agnès Mateo Ludwig Johanna Friedrich Salvador Dolores Kenji Aiko Mariam Tariq Kofi".split()
MORE_GIVEN = "Donald Mark Steven Kenneth Kevin Brian Ronald Timothy Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Gregory Alexander Raymond Jack Dennis Jerry Tyler Aaron Henri Douglas Nathan Peter Zachary Kyle Walt Ethan Jeremy Albert Neil Keith Roger Terry Lawrence Sean Christian Austin Louis Ralph Roy Eugene Randy Philip Russell Gabriel Alan Juan Wayne Bruce Willie Joe Ernest Nelson Sandra Ashley Kimberly Donna Emily Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Sharon Cynthia Kathleen Amy Angela Shirley Brenda Pamela Nicole Samantha Katherine Christine Debra Rachel Carolyn Janet Maria Heather Diane Virginia Julie Joyce Victoria Kelly Christina Lauren Joan Evelyn Judith Megan Andrea Cheryl Jacqueline Ann Jean Alice Judy Sophia Grace Denise Amber Doris Marilyn Danielle Beverly Theresa Diana Natalie Brittany Charlotte Marie Kayla Alexis Lori Ada Rosa Edith Clara Lucy Giuseppe Antonio Mario Luigi Angelo Günther Dieter Gerhard Karl Hans Fritz Renate Sabine Brigitte Jacques Michel Bernard Philippe Nathalie Isabelle Sylvie Francisco Manuel Teresa Raúl Sergio Boris Viktor Nikolai Tatiana Kofi Desmond Winston Malala".split()
MORE_FAMILY = "Allen Bennett Brooks Butler Carpenter Chapman Coleman Crawford Cruz Dixon Duncan Dunn Elliott Ellis Ferguson Fisher Ford Foster Fox Franklin Freeman Gibson Gordon Graham Grant Gray Griffin Hamilton Harper Harrison Hart Harvey Hayes Henderson Henry Holmes Hudson Hughes Hunt Hunter James Jenkins Jordan Kennedy Kim Knight Lane Lawrence Lee Long Marshall Mason Matthews McCarthy Mills Morgan Murray Myers Newman Nichols Oliver Owens Palmer Parks Payne Perkins Perry Pierce Porter Powell Price Reynolds Rice Robertson Rose Ross Russell Ryan Sanders Scott Shaw Simpson Snyder Spencer Stevens Stone Sullivan Tucker Wallace Warren Weaver Webb Wells West Wheeler Woods Brandt Busch Engel Frank Fuchs Graf Haas Jung Kaiser Keller Kraus Krüger Lange Lorenz Ludwig Maier Mann Roth Sauer Schmitt Schreiber Schubert Schuster Seidel Simon Stein Vogel Vogt Walter Weiß Winkler Blanc Boyer Chevalier Colin David Faure Fournier Gauthier Henry Lambert Lemaire Marchand Noël Perrin Picard Renard Robin Roussel Roux Vidal Alonso Blanco Cano Castro Cruz Delgado Domínguez Fernández Guerrero Herrera Iglesias Jiménez Medina Molina Muñoz Navarro Núñez Ramos Reyes Rojas Rubio Ruiz Serrano Soto Suárez Vega".split()
FAMILY = "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Thomas Moore Martin Jackson Thompson White Harris Clark Lewis Robinson Walker Hall Young King Wright Green Baker Adams Nelson Hill Campbell Mitchell Roberts Carter Phillips Evans Turner Parker Collins Edwards Stewart Morris Murphy Cook Rogers Cooper Peterson Reed Bailey Bell Kelly Howard Ward Cox Richardson Wood Watkins Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Schäfer Koch Bauer Richter Klein Wolf Schröder Neumann Zimmermann Hartmann Bergmann Lehmann Dupont Durand Leroy Moreau Laurent Lefebvre Girard Bonnet Rousseau Fontaine Mercier Garnier García Rodríguez Martínez Hernández López González Pérez Sánchez Ramírez Torres Flores Rivera Gómez Díaz Morales Ortiz Vázquez Castillo Rossi Russo Ferrari Esposito Bianchi Romano Colombo Ricci Marino Conti Hansen Johansen Olsen Larsen Nilsson Lindqvist Eriksson Bergström Nowak Kowalski Wiśniewski Zieliński Ivanov Petrov Smirnov Volkov Kuznetsova Okafor Adeyemi Nwosu Mensah Dlamini Nguyen Tran Pham Patel Sharma Singh Gupta Khan Hussain Ahmed Yılmaz Demir Kaya Tanaka Suzuki Yamamoto Chen Wang Zhang O'Brien O'Connor McDonald MacLeod Fitzgerald D'Angelo Papadopoulos Horváth Novák Dvořák Popescu Silva Santos Pereira Almeida".split()
CYRILLIC = (("Анна Иван Мария Дмитрий Ольга Сергей Наталья Алексей Елена Павел".split()), ("Иванова Петров Смирнова Кузнецов Попова Волков Соколова Морозов Новикова Фёдоров".split()))
HAN = (list("王李张刘陈杨黄赵周吴徐孙马朱胡郭何林高罗"), ["伟", "芳", "娜", "秀英", "敏", "静", "丽", "强", "磊", "军", "洋", "勇", "艳", "杰", "涛", "明", "超", "秀兰", "霞", "平", "建国", "志强", "小明", "晓东"])
TITLE = "Mr Mrs Ms Dr Dr. Prof. Frau Herr Madame Monsieur Señor Señora Sir".split()
CITIES = "London Paris Berlin Madrid Boston Chicago Munich Hamburg Lyon Sevilla Toronto Dublin Vienna Zürich Rome Oslo Lisbon Prague Austin Denver Leeds Bristol Köln Nantes Bilbao".split()
THINGS = "report garden kitchen bridge river engine letter market museum ticket window story meeting project school bakery printer lamp budget ferry forest recipe piano village harvest painting theory sample island lecture library signal".split()
COMMON = "able account action age air apple area army autumn baby balance band base basic battle beach bear beauty beetle bird bitter block blood board bone bottle bottom branch brass brave bright broken brother brown business butter camera candle capital carbon careful carpet castle cause century chain chamber change cheap chemical chief choice circle citizen clean clear climate clinic clock cloud coach coast coffee cold color column comfort common copper corner cotton council country county courage course cover cream credit crisis crowd crystal culture curtain custom daily danger dark data decade deep delta desert detail digital dinner distant doctor double dozen drama dream dress drink early earth eastern editor effect electric empire empty energy equal error estate evening event evidence exact express fabric fact factor fair family famous farm fashion feather fiction field figure final fire fiscal flat flood flower focus foreign formal former fresh frozen fuel future general gentle giant global gold grand guest habit hard heavy hidden history holiday honest horse hotel human ideal image income index inner iron journal junior justice keyboard kingdom knowledge labor ladder large last leather legal level light limit liquid local logic lucky lunch machine magic main major manual marble master matter medal medical memory mental metal method middle military mineral minor mirror mobile model modern moral motion mountain music narrow national native natural neutral night noble normal northern notice novel number object ocean office open opinion orange order organic outer oxygen paper partner patient pattern peace percent perfect pepper phase picture plain planet plastic pocket poet police policy popular position post power present price prime private prize process product profit project public pupil purple quality quarter quick quiet random rapid rare reason record region regular remote rescue reserve result rice ring rural safety salad salt science season second secret senior serious service shadow shape sharp shelter short silent silk silver simple single sister skill slow small smooth social soft solar solid source southern special speed spirit square stable stage standard station steady steel storage storm strange strong student studio subject sudden sugar supplier supply surface surplus sweet symbol system talent target teacher technical tender text thick tiger timber total tourist tower trade traffic travel treasure trial tropical trust tunnel union unique upper urban useful valley value vehicle version visible visual volume warm waste water weather weekly western winter wisdom wooden world worth yellow young zero".split()
ROADS = "Street St. St Road Rd Rd. Avenue Ave Ave. Lane Ln Drive Dr. Court Place Square Way Boulevard Blvd Crescent Close Terrace Row Hill Parkway Highway Grove Walk Gardens Mews".split()
ROAD_NAMES = "Baker Oak Maple Pine Church Mill Station Victoria Park Elm Washington Franklin Main High Market King Queen Cedar Lincoln Jefferson Bridge Castle Garden Spring Lake River Forest Chestnut Orchard Green Broad Union Academy Sunset Walnut Prospect Highland Meadow School Albert George Abbey".split()
RUES = "rue avenue boulevard place quai impasse allée chemin cours passage".split()
RUE_NAMES = "Paix République Victor Hugo Gare Moulin Église Fleurs Rivoli Voltaire Pasteur Gambetta Liberté Marché Fontaine Lilas Tilleuls Prés Vieux-Port Saint-Michel".split()
CALLES = "Calle C/ Avenida Avda. Plaza Paseo Camino Ronda Travesía Carrera".split()
CALLE_NAMES = "Mayor Alcalá Real Sol Toledo Luna Olmo Prado Goya Serrano Molino Fuente Rosas Cervantes Colón Libertad".split()
VIE = "Via Viale Piazza Corso Vicolo".split()
VIA_NAMES = "Roma Garibaldi Mazzini Dante Verdi Cavour Manzoni Milano Marconi Nazionale".split()
STRASSEN = "straße strasse str. weg gasse allee platz ring damm ufer steig hof berg graben".split()
STRASSE_NAMES = "Haupt Bahnhof Garten Schul Berliner Linden Kirch Berg Wald Wiesen Goethe Schiller Mozart Dorf Markt Rosen Ahorn Birken Sonnen Post Brunnen Mühlen".split()
PREPOSED = "Am Markt;Am Bahnhof;Im Winkel;Auf der Höhe;An der Mühle;Unter den Eichen;In der Au;Zum Anger;Zur Linde;Am Alten Hafen;Hinter der Kirche;Am Stadtpark;An der Alten Post;Am Wehr;Im Grund;Unter den Ulmen;Am Sandtor;Am Wall".split(";")
ALONE = "Broadway;Piccadilly;Strand;Whitehall;The Mall;Kurfürstendamm;Graben;Cheapside;Bowery;Embarcadero;Haymarket;Pall Mall;Zeil".split(";")
TEXTS = """The committee met on Monday and approved the budget for the coming year.
Most visitors arrive by train and walk to the harbour before lunch.
Rain is expected in the north, with sunny spells later in the week.
Our team tested twelve engines and found that two of them overheated.
Please read the instructions before you open the box.
In London the museum opens at nine, but the garden stays closed until May.
A reader in Boston thinks that the recipe needs less salt.
The Royal Society published the results in March, and the press followed.
Why does the printer stop after forty pages? Nobody at the help desk knew.
The river is calm today but rises quickly after a storm.
New York and Los Angeles reported the highest numbers this spring.
World War II changed the town, as the National Archives show.
Apple Pie Recipe and Summer Salad Ideas
Small Gardens Matter More Than Ever, A New Study Finds
How To Repair A Wooden Boat In Five Easy Steps
Terms And Conditions Apply To All Orders Placed Online
Annual Report Of The Water Board
Subscribe to our newsletter for the best stories of the week.
Home About Contact News Archive Sign In
Breaking News: City Council Approves New Bridge Over Green River
The Central Bank raised rates; Deutsche Bank and Credit Union shares fell.
Microsoft Windows and Google Chrome were updated on Tuesday.
A Guide To Better Sleep And Healthy Meals
Die Versammlung beginnt um acht Uhr im großen Saal der Schule.
Neue Brücken werden selten ohne Förderung gebaut.
Jede Gemeinde braucht eine Bibliothek, sagt die Ministerin.
Die Fabrik wurde 1893 gegründet und stellte Papier her.
Hamburg hat seit 1950 eine Messe für Bücher.
Ruhige Wohnungen liegen meist am Rand der Stadt.
Der Neue Fahrplan Für Den Winter Ist Da
Im Sommer war der Garten trocken, die Ernte fiel aus.
Der Bundestag und das Amt für Statistik veröffentlichten neue Zahlen.
Der Kölner Dom wird wohl nie fertig.
Le conseil municipal a voté le budget pour la bibliothèque.
Chaque matin, le marché de la place attire beaucoup de monde.
Notre école aura un nouveau toit avant l'hiver.
La rivière était basse cet été, faute de pluie.
La gare de Paris sera bientôt rénovée.
Les Meilleures Adresses Pour Un Week-End À La Mer
La Banque de France et le Conseil d'État ont publié un avis.
El ayuntamiento aprobó el presupuesto para la nueva biblioteca.
Cada mañana el mercado de la plaza se llena de gente.
La feria de Sevilla atrae a miles desde 1920.
Las carreteras no se construyen sin permiso.
Los Mejores Árboles Para La Ciudad En Verano
El Banco Central y la Cruz Roja firmaron un acuerdo.
for n in range(10): total.append(n * 2)
{"count": 12, "items": ["lamp", null], "ok": true}
$$\\sum_{i=1}^{9} x_i^{2} \\leq 0.75$$
def run(self): return self.value + 1
We compared sample A with sample B and kept neither.
Section 4 of the Data Act covers the Public Register and the Trade Office.
Behind the old mill the path climbs; Lower Field is to the left.
Grace Period: thirty days. Mark Sheet attached. Will Power is not enough.
June Edition of the Garden Review, Volume 3
Hope Street was quiet, and Victoria Station crowded.
Chase Bank and Ford Motor opened branches near Lincoln Center.
Florence Museum and the Virginia Coast draw crowds in Summer.
Frank Discussion, Rose Garden, Art School, Bill Payment, Iris Scan
Guests like the Olive Branch, and Pearl Harbor is a museum now.
Summer Rain and Morning Frost are shades of paint.
Based on Max Height and Min Width, the Grid Layout is drawn.
User Guide: Open Source License, Quick Start, Known Issues
Thanks to Regular Maintenance the engine ran.
According to Federal Law, the tax is due in April.
Best Western Hotel, Grand Hotel, Red Cross, Blue Note
Dear Customer, your parcel is on its way. Kind regards, Customer Service
North Sea, Black Forest, Lake Geneva, Mount Everest, Cape Town""".split("\n")
FORMS = r"""~NAME~ joined the company in 2011 and now leads the sales team.
Last week ~NAME~ told reporters that the ~W~ would stay closed.
The novel by ~NAME~ sold well, critics say.
I spoke to ~NAME~ about the ~W~, and we agreed.
After lunch, ~NAME~ and ~NAME~ went to see the ~W~.
Thanks, ~NAME~
Regards,\n~NAME~
Kind regards\n\n~NAME~\n~ADDR~\n~PHONE~
Sincerely,\n~NAME~\n~MAIL~
Signed: ~NAME~, ~C~
~T~ ~NAME~ will chair the meeting.
We asked ~T~ ~NAME~ to repair the ~W~.
By ~NAME~
By ~NAME~ | Staff writer
Posted by ~NAME~ at 10:42
Author: ~NAME~
Name: ~NAME~
name=~NAME~
"name": "~NAME~",
{"user": "~NAME~", "email": "~MAIL~", "n": ~N~}
~N~,~NAME~,~C~,~W~
~NAME~,~MAIL~,~PHONE~
~NAME~ (~MAIL~)
From: ~NAME~ <~MAIL~>
~NAME~ <~MAIL~> wrote:
cc: ~NAME~, ~NAME~
"That ~W~ is mine," said ~NAME~.
my friend ~NAME~ likes the ~W~
the ~W~ was found by ~NAME~ in ~C~.
According to ~NAME~, the ~W~ is old.
Thanks to ~NAME~ the ~W~ works again.
hi, I am ~NAME~ and I lost my ~W~
My name is ~NAME~, I live in ~C~.
this is ~NAME~ speaking
In ~C~, ~NAME~ opened a ~W~.
If ~NAME~ calls, tell them the ~W~ is ready.
Patient ~NAME~ was seen on day ~N~.
the defendant, ~NAME~, denied it
Mein Name ist ~NAME~ und ich komme aus ~C~.
Gestern sprach ~NAME~ über die Schule.
Laut ~NAME~ ist die Brücke alt.
Die Lehrerin ~NAME~ und ihr Mann kamen spät.
Sehr geehrte Frau ~NAME~, vielen Dank.
Mit freundlichen Grüßen\n~NAME~
Danke an ~NAME~ für die Hilfe.
Hier wohnt ~NAME~ seit Jahren.
Je m'appelle ~NAME~ et je viens de ~C~.
Selon ~NAME~, la gare est fermée.
Hier, ~NAME~ a présenté la maison.
Merci à ~NAME~ pour la lettre.
Cordialement,\n~NAME~
Me llamo ~NAME~ y vivo en ~C~.
Según ~NAME~, la carta llegó tarde.
Ayer ~NAME~ presentó el informe.
Gracias a ~NAME~ por la ayuda.
Atentamente,\n~NAME~
When the ~W~ broke, ~NAME~ fixed it.
~NAME~ ~V~ the ~W~.
~NAME~ ~V~ it.
The ~J~ ~NAME~ ~V~ first.
the ~J~ ~NAME~ and the ~J~ ~NAME~
a ~W~ of ~NAME~ and one by ~NAME~
It was ~NAME~ who ~V~ the ~W~.
a letter to ~NAME~ from ~NAME~
~NAME~, a ~J~ from ~C~, ~V~ the ~W~.
In 1999, ~NAME~ ~V~ a ~W~.
We met ~NAME~ in ~C~; ~NAME~ came later.
books by ~NAME~, ~NAME~ and ~NAME~
~J~: ~NAME~
Photo ~NAME~
Ask ~NAME~ why the ~W~ ~V~ so well.
with ~NAME~ as ~J~
~NAME~ and ~NAME~ ~V~ together.
Der ~J~ ~NAME~ kam aus ~C~.
Das Buch von ~NAME~ liegt in der Schule.
~NAME~ wurde in ~C~ geboren.
Gestern hat ~NAME~ den Garten verkauft.
Nach Ansicht von ~NAME~ war es gut.
Ein Roman von ~NAME~ erscheint bald.
Le livre de ~NAME~ est paru.
Ce soir ~NAME~ chante à ~C~.
~NAME~ est né à ~C~.
La novela de ~NAME~ salió ayer.
~NAME~ nació en ~C~.
El cuadro de ~NAME~ está en ~C~.
owner ~NAME~ / ~N~
- ~NAME~: buy a ~W~
Speaker: ~NAME~ (~C~)
Меня зовут ~CYR~, я живу здесь.
Вчера ~CYR~ сказала, что всё хорошо.
Автор: ~CYR~
我叫~HAN~，今年三十岁。
姓名：~HAN~
~HAN~先生您好
作者：~HAN~
~HAN~女士住在这里。
我的朋友~HAN~是老师。
Call me on ~PHONE~ after five.
Phone: ~PHONE~
Tel. ~PHONE~
tel ~PHONE~
Telephone ~PHONE~ or fax ~PHONE~
Mobile ~PHONE~
You can reach us at ~PHONE~.
ring ~PHONE~ if the ~W~ turns up
text ~PHONE~ now
My number is ~PHONE~.
the number is ~PHONE~, ask for the ~W~
phone=~PHONE~&x=~N~
"phone": "~PHONE~"
"tel": "~PHONE~"}
contact,~PHONE~,~N~
tel_no,~PHONE~,~N~
home_phone,~PHONE~
mobile,~PHONE~,~W~
phone_number,~PHONE~,~N~
street_address,~ADDR~
postal_address,~ADDR~,~N~
addr,~ADDR~
~NAME~\n~ADDR~\n~PHONE~
~NAME~\n~ADDR~\n~PHONE~\n
~W~ was here.\n~NAME~\n~ADDR~\n~PHONE~
~NAME~\n~PHONE~
~NAME~\n~ADDR~
--\n~NAME~\n~PHONE~
--\n~NAME~ <~MAIL~>
Yours,\n\n~NAME~\n\n
~MAIL~ | ~PHONE~
~NAME~ | ~MAIL~ | ~PHONE~\n--
Dial ~PHONE~ for help
WhatsApp ~PHONE~
Telefon: ~PHONE~
Telefonnummer ~PHONE~
Rufen Sie ~PHONE~ an.
Erreichbar unter ~PHONE~ bis 18 Uhr.
Handy ~PHONE~
Téléphone : ~PHONE~
Appelez le ~PHONE~ avant midi.
Tél : ~PHONE~
Joignable au ~PHONE~.
Teléfono: ~PHONE~
Llame al ~PHONE~ por la tarde.
Móvil ~PHONE~
Hotline ~PHONE~ (free)
(~PHONE~)
~PHONE~
Social security number ~ID~
SSN ~ID~
SSN: ~ID~
my ssn is ~ID~ please keep it safe
"ssn": "~ID~",
ssn=~ID~;
Passport number: ~ID~
passport no ~ID~
Passport No. ~ID~ was issued in ~C~.
Passport ~ID~ expired
National ID ~ID~
national insurance number ~ID~
NI number: ~ID~
Identity card ~ID~
identity number ~ID~, valid
ID card no. ~ID~
Personal identification number ~ID~
Tax ID: ~ID~
tax number ~ID~
taxpayer ~ID~
tin=~ID~
Personalausweis Nr. ~ID~
Ausweisnummer ~ID~
Reisepass ~ID~
Reisepassnummer: ~ID~
Steuer-ID ~ID~
Steueridentifikationsnummer: ~ID~
Sozialversicherungsnummer ~ID~
Rentenversicherungsnummer ~ID~
Numéro de sécurité sociale ~ID~
numéro de sécu : ~ID~
Carte d'identité ~ID~
carte nationale d'identité n° ~ID~
Passeport n° ~ID~
numéro fiscal ~ID~
Mon numéro national est le ~ID~.
DNI ~ID~
DNI: ~ID~
NIE: ~ID~
NIF ~ID~
con DNI ~ID~ y domicilio en ~C~
Mi DNI es ~ID~.
Pasaporte ~ID~
número de identidad ~ID~
Número de la seguridad social ~ID~
codice fiscale ~ID~
"passport": "~ID~"
"national_id": "~ID~"
"id_number": "~ID~"
holder_id ~ID~
applicant with identity number ~ID~
citizen ~ID~ verified
id number ~ID~
I live at ~ADDR~.
We moved to ~ADDR~ last year.
Address: ~ADDR~
address=~ADDR~
"address": "~ADDR~"
Send the ~W~ to ~ADDR~, ~C~.
~ADDR~, ~C~
~NAME~, ~ADDR~, ~C~
The shop at ~ADDR~ sells ~W~s.
meet me outside ~ADDR~ at noon
The ~W~ at ~ADDR~ burned down.
home,~ADDR~,~N~
Delivered to ~ADDR~ on day ~N~
Come to ~ADDR~ tomorrow.
my office is at ~ADDR~
Visit us at ~ADDR~
Anschrift: ~ADDR~
Ich wohne in der ~ADDR~.
Er wohnt ~ADDR~, im zweiten Stock.
Lieferung an ~ADDR~
Die Praxis liegt ~ADDR~.
J'habite au ~ADDR~.
Adresse : ~ADDR~
Le magasin se trouve ~ADDR~, à ~C~.
Livraison au ~ADDR~ avant midi
Vivo en ~ADDR~.
Dirección: ~ADDR~
La tienda está en ~ADDR~, ~C~.
Entregar en ~ADDR~ por la tarde
Abito in ~ADDR~.
~ADDR~
Email me at ~MAIL~
Email: ~MAIL~
E-mail ~MAIL~ for details.
mail ~MAIL~ or call ~PHONE~
Contact ~MAIL~
contact: ~MAIL~
Send it to ~MAIL~, please.
please write to ~MAIL~ about the ~W~
(~MAIL~)
<~MAIL~>
mailto:~MAIL~
"email": "~MAIL~"
email=~MAIL~&n=~N~
owner: ~MAIL~
# maintainer ~MAIL~
@author ~MAIL~
ask ~MAIL~ first
ping ~MAIL~ if it fails
reply to ~MAIL~.
my address is ~MAIL~ if you need it
Schreiben Sie an ~MAIL~.
Kontakt: ~MAIL~
Écrivez à ~MAIL~ avant lundi.
Contact : ~MAIL~
Escriba a ~MAIL~ hoy.
Correo: ~MAIL~
~MAIL~
| ~NAME~ | ~MAIL~ | ~PHONE~ |
~NAME~\n~ADDR~\n~C~\n~PHONE~
~NAME~ - ~PHONE~
~NAME~; DNI ~ID~; ~ADDR~"""
FORMS = [f.replace("\\n", "\n") for f in FORMS.split("\n")]
KIND = {"NAME": "name", "CYR": "name", "HAN": "name", "PHONE": "phone", "ID": "id", "ADDR": "address", "MAIL": "email"}


class World:
    """Names, of which the lexicon lists a part."""

    def __init__(self, r: random.Random, invented: bool, other: World | None = None):
        self.r = r
        self.given, self.family = sorted({*GIVEN, *MORE_GIVEN}), sorted({*FAMILY, *MORE_FAMILY})
        if invented:
            c, v = "bdfghjklmnprstvwz", "aeiou"
            piece = lambda: r.choice(c) + r.choice(v) + r.choice(["", "", r.choice("lmnrs")])
            ends = [r.choice(["", r.choice(c)]) + r.choice(v) + r.choice([r.choice(c), r.choice(c) + r.choice(v), r.choice("lnrst") + r.choice("dkst")]) for _ in range(r.randrange(6, 14))]
            self.family = sorted({(piece() + (piece() if r.random() < 0.8 else "") + r.choice(ends)).capitalize() for _ in range(320)})
        r.shuffle(self.given)
        r.shuffle(self.family)
        self.lexicon = Lexicon([("given", g) for g in self.given[: r.randrange(20, 60)]] + [("family", f) for f in self.family[: r.randrange(60, 110)]])
        if other:
            # A list that knows next to none of the names in use.
            self.lexicon = Lexicon([("given", g) for g in self.given[:3]] + [("family", f) for f in other.family[:90]])


class Maker:
    def __init__(self, seed: int):
        self.r = r = random.Random(seed)
        self.worlds = [World(r, i % 2 == 1) for i in range(WORLDS)]
        self.worlds += [World(r, False, self.worlds[1 + 2 * (i % (WORLDS // 2))]) for i in range(WORLDS)]
        self.world = self.worlds[0]

    def d(self, shape: str) -> str:
        r = self.r
        return "".join(str(r.randrange(10)) if c == "9" else str(r.randrange(2, 10)) if c == "N" else r.choice("ABCEGHJKLMNPRSTVWXYZ") if c == "@" else c for c in shape)

    def word(self) -> str:
        """An invented word, as a name of a place or thing."""
        r = self.r
        return "".join(r.choice("bdfghklmnprstvwxz") + r.choice("aeiou") + r.choice(["", "", r.choice("lnrsm")]) for _ in range(r.randrange(2, 4))) + r.choice(["", "ia", "ton", "ery", "um", "al", "or", "heit", "ung", "schaft", "ing", "ance", "eza", "ite", "el", "burg", "ville"])

    def plain(self) -> str:
        """An invented word without an ending of places and things."""
        r = self.r
        return "".join(r.choice("bcdfghjklmnprstvwz") + r.choice("aeiou") + r.choice(["", "", r.choice("lnrsm")]) for _ in range(r.randrange(1, 4))) + r.choice(["", "", r.choice("aeiou"), r.choice("nrslkdt")])

    def name(self) -> str:
        r, w = self.r, self.world
        g, f = r.choice(w.given), r.choice(w.family)
        if r.random() < UNKNOWN:
            f = self.word().capitalize() if r.random() < 0.5 else self.plain().capitalize()
        elif r.random() < 0.05:
            f = r.choice(COMMON).capitalize() + r.choice(["", "s", ""])
        if r.random() < UNKNOWN:
            g = self.plain().capitalize()
        if r.random() < 0.12:
            g += "-" + r.choice(w.given)
        if r.random() < 0.14:
            f += "-" + r.choice(w.family)
        elif r.random() < 0.08:
            f += " " + r.choice(w.family)
        x = r.random()
        if x < 0.14:
            g += f" {r.choice('ABCDEFGHJKLMNPRSTVW')}."
        elif x < 0.18:
            g += " " + r.choice(w.given)
        elif x < 0.21:
            g = f"{g[0]}."
        if r.random() < 0.15:
            f = r.choice(["von", "van", "van der", "de la", "du", "de", "del", "di", "da", "dos", "von der", "le", "ter", "zu", "bin", "el"]) + " " + f
        x = r.random()
        if x < 0.1:
            return f"{f}, {g}"
        if x < 0.14:
            return f"{f} {g}"
        n = f"{g} {f}"
        return n.upper() if x > 0.93 else n

    def phone(self) -> str:
        r = self.r
        return self.d(r.choice([
            "+1-N99-N99-9999", "+1 N99 N99 9999", "(N99) N99-9999", "N99-N99-9999", "N99.N99.9999", "1-N99-N99-9999", "1 N99 N99 9999", "+1 (N99) N99-9999", "+1.N999999999", "N99 N99 9999", "+1N99N999999", "N99N999999", "(N99)N99-9999",
            "0N 99 99 99 99", "0N.99.99.99.99", "0N-99-99-99-99", "0N99999999", "+33 N 99 99 99 99", "+33N99999999", "+33 (0)N 99 99 99 99", "0033 N 99 99 99 99", "06 99 99 99 99", "01 99 99 99 99",
            "07N99 999999", "07N99 999 999", "+44 7N99 999999", "+44 7N99 999 999", "+447N99999999", "020 N999 9999", "(020) N999 9999", "+44 20 N999 9999", "01N99 999999", "(01N99) 999999", "0044 20 N999 9999", "0044 1N99 999999", "0044 7N99 999999", "00" + "N" + "9" * r.randrange(1, 3) + " N" + "9" * r.randrange(1, 4) + " " + "9" * r.randrange(5, 8), "+44 (0)20 N999 9999",
            "6N9 999 999", "6N9 99 99 99", "+34 6N9 999 999", "+34 9N9 99 99 99", "9N9 999 999", "0034 6N9 999 999", "+346N9999999", "7N9 999 999", "8N9 99 99 99",
            "030 N9999999", "030/N9999999", "030-N999999", "+49 30 N9999999", "+49 (0)30 N9999999", "+49 (0)30 N9999-999", "0049 30 N999999", "(030) N999999", "0N99 9999999", "0N99/9999999", "+49 1N9 9999999", "01N9 99999999", "01N9-9999999", "0N999 99999", "(0)30 N99999", "0N99 999 9999", "+49.30N9999999", "030 N999 9999", "089/N999-999",
            "+39 06 9999 9999", "+39 3N9 999 9999", "+41 44 N99 99 99", "044 N99 99 99", "+43 1 N999999", "+91 N9999 99999", "+86 1N9 9999 9999", "+81 3-9999-9999", "+31 20 N99 9999", "+48 N99 999 999", "+351 9N9 999 999", "+7 N99 999-99-99", "+55 11 9N999-9999", "+61 4N9 999 999", "+353 1 N99 9999", "00 49 30 N99999", "+32 2 N99 99 99", "+420 N99 999 999", "0N" + "9" * r.randrange(0, 3) + r.choice(" /-") + "N" + "9" * r.randrange(4, 8), "0N" + "9" * r.randrange(1, 3) + " N" + "9" * r.randrange(1, 4) + " " + "9" * r.randrange(2, 5), "+" + "9" * r.randrange(1, 3) + " N" + "9" * r.randrange(1, 3) + " N" + "9" * r.randrange(5, 8),
        ]))

    def id(self) -> str:
        return self.d(self.r.choice([
            "999-99-9999", "999-99-9999", "999 99 9999", "@@999999@", "@@ 99 99 99 @", "@@ 999999 @", "99999999@", "99999999-@", "99.999.999-@", "99 999 999 @", "X9999999@", "Y-9999999-@", "Z9999999@", "1 99 99 99 999 999 99", "2 99 99 99 999 999 99", "199999999999999", "299999999999999", "1 99 99 99 999 999",
            "@9999999", "@99999999", "@@9999999", "@@999999", "999999999", "N99999999", "@99@99999", "@999999999", "99 999 999 999", "99999999999", "99 999999 @ 999", "999.999.999-99", "9999 9999 9999", "@@@999999", "99@@99999", "999999-9999", "99999999 @", "99-9999999",
        ]))

    def address(self) -> str:
        r = self.r
        n = str(r.randrange(1, r.choice([20, 300, 3000]))) + (r.choice("abcABC") if r.random() < 0.15 else "")
        pick = lambda own: r.choice(own) if r.random() < 0.5 else self.word().capitalize()
        flat = f",{r.choice([' ', ' '])}{r.choice(['Flat', 'Apt', 'Apt.', 'Apartment', 'Unit', 'Suite', 'apt', 'Ste', 'Floor'])} {r.randrange(1, 60)}{r.choice(['', '', 'A', 'B', 'C'])}" if r.random() < 0.25 else ""
        x = r.random()
        if x < 0.36:
            old = r.choice(["Old ", "New ", "Upper ", "Lower ", "North ", "South ", "East ", "West ", "N ", "Great ", "St. "]) if r.random() < 0.2 else ""
            two = " " + pick(ROAD_NAMES) if r.random() < 0.12 else ""
            tail = " " + r.choice(["NW", "SE", "N", "West", "East", "South"]) if r.random() < 0.06 else ""
            return f"{n} {old}{pick(ROAD_NAMES)}{two} {r.choice(ROADS)}{tail}{flat}".replace(".,", ",") if flat else f"{n} {old}{pick(ROAD_NAMES)}{two} {r.choice(ROADS)}{tail}"
        if x < 0.42:
            return f"{n} {r.choice(ALONE)}{flat}"
        if x < 0.57:
            fr = f", {r.choice(['appt', 'Appt', 'Appartement', 'bte'])} {r.randrange(1, 40)}" if r.random() < 0.15 else ""
            return f"{n}{r.choice(['', '', '', ' bis', ' ter'])}{r.choice([', ', ' ', ' '])}{r.choice(RUES)} {r.choice(['de la ', 'du ', 'des ', 'de ', '', '', 'de l’', chr(100) + chr(39)])}{pick(RUE_NAMES)}{r.choice(['', '', ' ' + pick(RUE_NAMES)])}{fr}"
        if x < 0.72:
            es = f", {r.choice(['piso', 'Piso', 'puerta', 'Pta.'])} {r.randrange(1, 9)}{r.choice(['', 'A', ' B'])}" if r.random() < 0.15 else ""
            return f"{r.choice(CALLES)} {r.choice(['', '', 'de ', 'del ', 'de la ', 'de los '])}{pick(CALLE_NAMES)}{r.choice(['', '', ' ' + pick(CALLE_NAMES)])}{r.choice([', ', ' ', ' n.º ', ', nº ', ', '])}{n}{es}"
        if x < 0.76:
            return f"{r.choice(VIE)} {pick(VIA_NAMES)}{r.choice([' ', ', '])}{n}"
        de = f", {r.choice(['Wohnung', 'Whg.', 'Apt'])} {r.randrange(1, 30)}" if r.random() < 0.12 else ""
        n = n + r.choice(["", "", "", " a", " b"]) if n.isdigit() else n
        if x < 0.85:
            return f"{r.choice(PREPOSED) if r.random() < 0.6 else r.choice(['Am', 'An der', 'Im', 'Auf dem', 'Zum', 'Zur', 'In der', 'Unter den', 'Am Alten']) + ' ' + self.word().capitalize()} {n}{de}"
        if x < 0.9:
            return f"{pick(STRASSE_NAMES)}er {r.choice(['Straße', 'Str.', 'Platz', 'Allee', 'Weg', 'Ring', 'Chaussee', 'Ufer', 'Damm'])} {n}{de}"
        return f"{pick(STRASSE_NAMES)}{r.choice(STRASSEN)} {n}{de}"

    def email(self) -> str:
        r = self.r
        flat = lambda s: "".join(c for c in s.lower() if c.isascii() and (c.isalpha() or c == "'"))
        f, g = flat(r.choice(self.world.family)), flat(r.choice(self.world.given)) or "kim"
        f = f or "doe"
        local = r.choice([f"{g}.{f}", f"{g[0]}.{f}", f"{g[0]}{f}", f"{g}_{f}", f"{g}-{f}", f"{f}{r.randrange(99)}", f"{g}.{f}+{r.choice(THINGS)}", f, g, f"{r.choice(THINGS)}{r.randrange(99)}", r.choice("info sales office help contact admin press jobs".split()), f"{f}.{r.choice(THINGS)}"])
        host = r.choice([self.word(), f, r.choice(THINGS), "mail", "gmail", "example", f"{self.word()}-{r.choice(THINGS)}"])
        parts = [*([r.choice(["mail", "cs", "post", "dept", "uk"])] if r.random() < 0.3 else []), host, *r.choice([["com"], ["org"], ["net"], ["de"], ["fr"], ["es"], ["edu"], ["co", "uk"], ["io"], ["example"], ["test"], ["example", "org"], ["invalid"], ["eu"], ["info"]])]
        x = r.random()
        at, dot = ("@", ".") if x < 0.55 else (" @ ", ".") if x < 0.61 else ("(at)", ".") if x < 0.67 else (" [at] ", " [dot] ") if x < 0.74 else (" at ", " dot ") if x < 0.88 else ("[at]", "[dot]") if x < 0.93 else (" (at) ", " (dot) ") if x < 0.97 else (" {at} ", ".")
        if dot != "." and "." in local and r.random() < 0.4:
            local = local.replace(".", dot)
        e = local + at + dot.join(parts)
        return e.upper() if r.random() < 0.08 else e

    def other(self) -> str:
        """Numbers, places and the like that are no personal information."""
        r, d = self.r, self.d
        w = lambda: self.word().capitalize()
        t = lambda: r.choice(THINGS if r.random() < 0.3 else COMMON) + r.choice(["", "", "", "s", "s", "ed", "ing"])
        label = r.choice(["article", "Article no.", "order", "Order number", "invoice", "Invoice no.", "item", "SKU", "part number", "serial", "Serial no.", "ref", "Ref.", "ticket", "Ticket #", "tracking", "tracking number", "batch", "lot", "model", "case", "IBAN", "account", "Account no.", "Artikelnummer", "Art.-Nr.", "Bestellnummer", "Rechnung Nr.", "Rechnungsnummer", "Auftrag", "Kundennummer", "Seriennummer", "commande n°", "facture n°", "référence", "réf.", "article n°", "pedido", "factura", "referencia", "n.º de serie", "artículo", "EAN", "barcode", "product code", "build", "hash", "commit", "session", "transaction", "coupon", "flight", "booking", "meter reading", "VIN", "patent", "ISBN", "ISSN", "DOI", "page", "size", "chapter"])
        many = self.id() if r.random() < 0.6 else self.phone().strip("+") if r.random() < 0.1 else d(r.choice(["9999-9999", "99-999-99", "999-9999-99", "99999999", "9999999", "@@@-99999", "999999999999", "9999-99-999", "978-9-99-999999-9", "978-9-9999-9999-@", "9999 9999 9999 9999", "@@99 9999 9999 9999 9999 99"]))
        small = sorted(FUNCTION)

        def title() -> str:
            """A heading, all of its words with a capital."""
            words = [r.choice([w(), w(), t().capitalize(), r.choice(small).capitalize(), r.choice(small).capitalize(), str(r.randrange(2, 2000)) if r.random() < 0.3 else w()]) for _ in range(r.randrange(3, 11))]
            line = " ".join(words) + r.choice(["", "\n", "\n\n", "?", "."])
            return line.upper() if r.random() < 0.1 else line

        return r.choice([
            lambda: f"{label}{r.choice([' ', ': ', ' ', ' = '])}{many}", lambda: f"{label} {many} {r.choice(['shipped', 'was closed', 'sold out', 'ist da', 'reçue', 'enviado'])}", lambda: f'"{label.lower()}": "{many}"', lambda: f"{label} {many}",
            lambda: f"Iteration {d('9999')} of {d('9999')}: error {d('9.999999')}, speed {d('999,999')}, time {d('999.99')}ms", lambda: f"{d('99999')}/{d('99999')} ({d('9.99')}%) done", lambda: f"{d('9999-99-99')} {d('99:99:99')} INFO {d('999.999')}", lambda: f"{d('99/99/2099')} and {d('99.99.2099')}", lambda: f"version {d('9.99.9999')} build {d('99999999')}", lambda: f"value {d('9.99999999')} ± {d('0.999')}", lambda: f"{d('999 999 999')} tokens, {d('9 999 999')} words", lambda: f"{d('999,999,999')} in total", lambda: f"192.168.{d('99')}.{d('99')}:{d('9999')}", lambda: f"x = {d('99999999')} + {d('99999')}",
            lambda: f"page {d('999')}, room {d('99')}, table {d('9')}", lambda: f"{r.choice(['Room', 'Chapter', 'Section', 'Figure', 'Table', 'Step', 'Volume', 'Kapitel', 'Abschnitt', 'Seite', 'Schritt', 'Zimmer', 'Página', 'Capítulo', 'Paso', 'Étape', 'Chapitre', 'Windows', 'Platz', 'Gate', 'Route', 'Highway', 'Line', 'Linie', 'Day', 'Tag', 'Nach', 'May', 'March', 'Mai', 'Level', 'Part', 'Version', 'Psalm'])} {d(r.choice(['9', '99', '999']))}{r.choice(['', ':', ',', ' ' + t()])}", lambda: f"{r.choice(['In', 'Since', 'Im Jahr', 'Seit', 'En', 'Desde', 'Depuis', 'By', 'Am Montag', 'Im Mai', 'Im Winter', 'Zum Jahr', 'Im Kapitel'])} {d('1999')} {r.choice(['a', 'eine', 'une', 'una', 'Wurde Eine', 'the'])} {t()}",
            lambda: f"{r.randrange(2, 99)} {r.choice(['Reasons', 'Ways', 'Steps', 'People', 'Minutes', 'Apples', 'Days', 'Meter', 'Euro', 'Jahre', 'Prozent', 'Tage', 'Uhr', 'Kilometer', 'Grad', 'Seiten', 'Things', 'Best', 'Percent', 'Years'])} {r.choice(['Why', 'To', 'und', 'per', 'von', 'of', 'in', ''])} {t()}", lambda: f"{r.choice(['Es gibt', 'Nur', 'Etwa', 'About', 'Exactly', 'Unos', 'Environ'])} {r.randrange(2, 999)} {w()}{r.choice(['e', '', 's'])}",
            lambda: f"{r.choice(['look', 'meet', 'arrive', 'stay', 'wait', 'meeting', 'works', 'price', 'closed', 'sale'])} at {r.choice([t(), self.word()])} {r.choice(['dot com', 'dot', 'today', 'now. Then'])} {t()}", lambda: f"{t()}@{d('9.99')}", lambda: f"follow @{self.word()} for more", lambda: f"build@{d('999')} failed", lambda: f"npm install {t()}@{d('9.9.9')}",
            lambda: f"{w()} {r.choice(['Street', 'Road', 'Park', 'Bank', 'Hill', 'Museum', 'Report', 'Review', 'Center', 'Institute', 'Council', 'Station', 'Company', 'Edition', 'Period', 'Festival', 'Award', 'Garden', 'Harbour', 'Bureau', 'Court'])} {r.choice(['was closed', 'opens soon', '', 'and the ' + t()])}", lambda: f"{r.choice(self.world.given)} {r.choice(['Street', 'Road', 'Park', 'Bank', 'Hill', 'Museum', 'Report', 'Center', 'Station', 'Edition', 'Period', 'Prize', 'Power', 'Sheet', 'Review', 'Garden', 'Payment', 'School', 'Island'])}{r.choice(['', ': 24 days', ', page 5', ' opens'])}", lambda: f"{r.choice(self.world.given)} said the {t()} was closed.", lambda: f"{r.choice(TITLE)} {r.choice(self.world.family)} {r.choice(['said so', 'left early', 'kam', ''])}", lambda: f"The {r.choice(self.world.family)} {r.choice(['Institute', 'Report', 'family', 'Company', 'method', 'Award', 'Group', 'Theorem'])} {t()}",
            lambda: f"{r.choice(['Q', 'A', 'Bot', 'Guest', 'Host', 'Client', 'Note', 'Frage', 'Antwort', 'Réponse', 'Nota'])}: {r.choice(small).capitalize()} {w()} {r.choice(small)} {t()}",
            lambda: f"{r.choice(['Past', 'Near', 'In', 'Beyond', 'From', 'Around', 'Outside', 'Towards'])} {w()} there is a {t()}.", lambda: f"{r.choice(['Keine', 'Jede', 'Diese', 'Ohne', 'Die', 'Eine', 'Nach', 'Wer', 'Aucune', 'Chaque', 'Sans', 'Ninguna', 'Cada', 'Sin', 'Most', 'Every', 'Without', 'No', 'When', 'Although', 'Behind', 'Visitors', 'Only', 'There'])} {w()} {r.choice(['braucht', 'ist', 'reste', 'mejora', 'keeps', 'and', 'oder'])} {r.choice([w(), t()])}", lambda: " ".join(r.choice([w(), w(), t().capitalize(), r.choice(['Why', 'The', 'A', 'Of', 'And', 'Und', 'Eine', 'Une', 'La', 'El', 'Braucht', 'Cherche', 'Needs', 'Meets'])]) for _ in range(r.randrange(3, 8))), lambda: f"{w()} and {w()} are towns.", lambda: f"{r.choice(['Mount', 'Port', 'Lake', 'Fort', 'Cape', 'San', 'Saint', 'New', 'Upper', 'Lower', 'North', 'Mont', 'Bad', 'Sankt', 'Monte', 'Río', 'Isla', 'Château'])} {w()} {r.choice(['and', 'und', 'et', 'y', 'is near', 'has a'])} {r.choice([t(), 'Port ' + w(), w()])}", lambda: f"{r.choice(['Step', 'Paso', 'Schritt', 'Étape'])} {d('99')}: {t().capitalize() if r.random() < 0.5 else w()} {r.choice(small).capitalize()} {w()} {t().capitalize()}", lambda: f"{t().capitalize()} {t().capitalize()} {r.choice(['is', 'was', 'and', 'has', ''])} {t()}", lambda: f"{r.choice(['Together With', 'According To', 'Because Of', 'Notes On', 'Where Is', 'What Comes After', 'Thanks To', 'One'])} {t().capitalize()} {t().capitalize()}{r.choice([', A ', ' ', '\n'])}{title()}", lambda: f"{r.choice(['Das', 'Die', 'Der', 'Ein', 'Le', 'La', 'El', 'The', 'Un', 'Una'])} {r.choice(['Büro', 'Haus', 'Ministerium', 'Conseil', 'Banco', 'Senate', w(), w()])}, {r.choice(['near', 'bei', 'cerca'])} {w()},", lambda: f"doi {d('10.9999')}/{d(r.choice(['999.9', '999.99', '99999', '@99.999']))}",
            title, title, title, lambda: f"In {d('1999')}, {r.choice(['a', 'the', 'one'])} {t()} {r.choice(['from', 'in'])} {w()} moved.", lambda: f"{r.choice(['In', 'En', 'By', 'Since', 'Um'])} {d('1999')}, {title()}", lambda: f"{r.choice(['Mit', 'Nach', 'Nur', 'De', 'Après', 'Of', 'After', 'We counted', 'Después de', 'Sur', 'Bei'])} {r.randrange(9, 990)} {r.choice(['Kisten', 'Tagen', 'Boxes', 'Cajas', 'Minuten', 'Stück', 'Caisses', 'Días', w(), w()])} {r.choice(['blieben', 'of', 'und', 'de', 'por', 'Of'])} {r.randrange(2, 99)}",
            lambda: f"{r.choice(['die', 'der', 'das', 'eine', 'auch die', 'la', 'une', 'the', 'The', 'El', 'Die'])} {r.choice([w() + r.choice(['ung', 'heit', 'el', 'schaft']), 'Schule', 'Brücke', 'Straße', 'Geschichte', 'Angaben', 'Roman', 'Universität', 'University', 'Bank', 'Ville', 'Banque', 'Ciudad', 'Gare', 'Bishop', 'Battle', 'König'])} {r.choice(['von', 'de', 'du', 'von der', 'of', 'del', 'de la'])} {r.choice([w(), r.choice(CITIES)])}", lambda: f"{r.choice(['meet', 'arrive', 'look', 'stay', 'work', 'wait'])} at {t()} dot {r.choice(['five', 'now', 'three', 'matrix', 'product', 'line', 'noon'])}", lambda: f"{t().capitalize()} {w()}. {w()} {t()} {r.choice(['und', 'or', 'y'])} {w()}",
            lambda: f"{t().upper()} {self.word().upper()} {t().upper()} {r.choice(['AND', 'OF', 'THE'])} {t().upper()}", lambda: f"{r.choice(CITIES)} {r.choice(CITIES)}", lambda: f"{t().capitalize()} {t().capitalize()}", lambda: f"{r.choice(['I', 'We', 'She', 'He'])} {r.choice(['like', 'saw', 'bought'])} {w()}",
            lambda: "我们的城市在河边，有很多人。", lambda: "高速公路和学校都在这里，王国很大。", lambda: "今天天气很好，金色的田野。", lambda: "В городе открыли новый мост через реку.", lambda: "Новая Школа и Большой Театр открыты.",
        ])()

    def sentence(self) -> tuple[str, list[tuple[int, int, str]]]:
        r = self.r
        self.world = r.choice(self.worlds)
        c, h = CYRILLIC, HAN
        values = {"NAME": self.name, "PHONE": self.phone, "ID": self.id, "ADDR": self.address, "MAIL": self.email, "W": lambda: r.choice(THINGS), "N": lambda: str(r.randrange(1, 99)), "V": lambda: r.choice("said wrote met left gave spoke moved fixed plays planted won lost opened sold bought painted built designed called died sang taught paid came chairs signed knew asked found took made hat kam sagte wohnt a est dijo vive".split()), "J": lambda: r.choice("doctor nurse teacher singer plaintiff witness neighbour lawyer tenant painter engineer pilot baker novelist judge mayor editor driver student author speaker Speaker Author Editor Witness Doctor poet actor chemist Lehrer Maler Arzt".split()), "C": lambda: r.choice(CITIES) if r.random() < 0.6 else self.word().capitalize(), "T": lambda: r.choice(TITLE), "CYR": lambda: f"{r.choice(c[0])} {r.choice(c[1])}", "HAN": lambda: r.choice(h[0]) + r.choice(h[1])}
        filler = lambda: r.choice(TEXTS) if r.random() < 0.4 else self.other()
        form = r.choice(FORMS) if r.random() < 0.6 else ""
        text, spans = "", []
        for _ in range(r.randrange(3)):
            text += filler() + r.choice([" ", "\n", "\n\n", ". "])
        for i, part in enumerate(form.split("~")):
            if i % 2 == 0:
                text += part
            else:
                v = values[part]()
                if part in KIND:
                    spans.append((len(text), len(text) + len(v), KIND[part]))
                text += v
        if (form and r.random() < 0.7) or not text:
            text += r.choice([" ", "\n", "\n\n"]) + filler()
        return text, spans


def log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def readings(text: str, found: list[Segment], score: list[float], factor) -> tuple[list[float], dict[tuple[int, int], float], float]:
    """Over all readings: the probability of each segment, of each pair of neighbours without a word between, and the log
    of the sum. found: sorted by end. factor(i, j): the factor of two such neighbours."""
    n = len(found)
    ends = [s.end for s in found]
    upto = [0.0]  # log sum of all readings within the first i segments
    alpha: list[float] = []
    pairs: list[tuple[int, int, float]] = []
    low: list[int] = []
    for i, s in enumerate(found):
        k = bisect.bisect_left(ends, adjacent(text, s.start), 0, i)
        low.append(k)
        total = upto[k]
        for j in range(k, bisect.bisect_right(ends, s.start, k, i)):
            x = alpha[j] + factor(j, i)
            pairs.append((j, i, x))
            total = log_add(total, x)
        alpha.append(total + score[i])
        upto.append(log_add(upto[-1], alpha[i]))
    # grad of the log sum: what of it passes through each place.
    passing = [0.0] * (n + 1)
    passing[n] = 1.0
    through = [0.0] * n
    both: dict[tuple[int, int], float] = {}
    by: dict[int, list[tuple[int, float]]] = defaultdict(list)
    for j, i, x in pairs:
        by[i].append((j, x))
    for i in range(n - 1, -1, -1):
        p = passing[i + 1]
        if p > 0:
            through[i] += p * math.exp(min(0.0, alpha[i] - upto[i + 1]))
            passing[i] += p * math.exp(min(0.0, upto[i] - upto[i + 1]))
        if through[i] > 0:
            base = alpha[i] - score[i]
            passing[low[i]] += through[i] * math.exp(min(0.0, upto[low[i]] - base))
            for j, x in by[i]:
                q = through[i] * math.exp(min(0.0, x - base))
                through[j] += q
                both[j, i] = q
    return through, both, upto[n]


def fit(seed: int = SEED, sentences: int = SENTENCES) -> dict[str, float]:
    maker = Maker(seed)
    models = {id(w): Model(None, w.lexicon) for w in maker.worlds}
    data = []
    for _ in range(sentences):
        text, spans = maker.sentence()
        found = models[id(maker.world)].segments(text)
        if found:
            found.sort(key=lambda s: (s.end, s.start, s.kind))
            right = [(s.start, s.end, s.kind) in spans for s in found]
            model = models[id(maker.world)]
            ends = [s.end for s in found]
            steps = {}
            for i, s in enumerate(found):
                k = bisect.bisect_left(ends, adjacent(text, s.start), 0, i)
                for j in range(k, bisect.bisect_right(ends, s.start, k, i)):
                    steps[j, i] = model.step(text, found[j], s)
            data.append((text, found, right, steps))
    weights: dict[str, float] = defaultdict(float)
    squares: dict[str, float] = defaultdict(lambda: 1e-6)
    rng = random.Random(seed)
    lexical = (":w=", ":bag=", ":local=", ":first=", ":last=", ":butlast=", ":sec=", ":two=", ":tld=", ":shape=9", ":ss=", ":sizes=", ":kbag=", ":w1=", ":n1=", ":s6=", ":s4=")
    shape = (":s2=", ":s3=", ":p2=", ":len=")
    level: dict[str, int] = {}
    for _ in range(ROUNDS):
        rng.shuffle(data)
        for text, found, right, steps in data:
            # Words of their own are left out of some segments, so that the other features learn to do without.
            drop = 2 if (x := rng.random()) < DROP / 2 else 1 if x < DROP else 0
            own = []
            for s in found:
                fs = s.features
                if drop:
                    fs = [f for f in fs if not 0 < (level[f] if f in level else level.setdefault(f, 1 if any(x in f for x in lexical) else 2 if any(x in f for x in shape) else 0)) <= drop]
                own.append(fs)
            through, both, _ = readings(text, found, [sum([weights[f] for f in fs]) for fs in own], lambda j, i: weights[steps[j, i]])
            step: dict[str, float] = defaultdict(float)
            for fs, y, p in zip(own, right, through):
                g = y - p
                if abs(g) > 1e-4:
                    for f in fs:
                        step[f] += g
            for (j, i), f in steps.items():
                step[f] += (right[j] and right[i]) - both.get((j, i), 0.0)
            for f, g in step.items():
                g -= DECAY * weights[f]
                squares[f] += g * g
                weights[f] += RATE * g / math.sqrt(squares[f])
    return {f: round(w, 2) for f, w in sorted(weights.items()) if abs(w) >= LEAST}


def marked(line: str) -> tuple[str, list[tuple[int, int, str]]]:
    """A text with values marked as {kind:value}, and where they stand."""
    text, spans, at = "", [], 0
    while (i := line.find("{", at)) >= 0:
        kind, colon, _ = line[i + 1 :].partition(":")
        j = line.find("}", i)
        if not colon or kind not in KINDS or j < 0:
            text += line[at : i + 1]
            at = i + 1
            continue
        text += line[at:i]
        value = line[i + len(kind) + 2 : j]
        spans.append((len(text), len(text) + len(value), kind))
        text += value
        at = j + 1
    return text + line[at:], spans


def accuracy(weights: dict[str, float], texts: list[tuple[str, list[tuple[int, int, str]], Lexicon]], show: bool = False) -> dict[str, tuple[float, float, int]]:
    """Precision, recall and the number of values by kind."""
    models: dict[int, Model] = {}
    hit, got, want = defaultdict(int), defaultdict(int), defaultdict(int)
    for text, spans, lexicon in texts:
        if id(lexicon) not in models:
            models[id(lexicon)] = Model(weights, lexicon)
        model = models[id(lexicon)]
        out = {(s.start, s.end, s.kind) for s in model.read(text)}
        for x in out:
            got[x[2]] += 1
            hit[x[2]] += x in spans
        for x in spans:
            want[x[2]] += 1
        if show and out != set(spans):
            print("-", [(text[a:b], k) for a, b, k in sorted(out - set(spans))], "+", [(text[a:b], k) for a, b, k in sorted(set(spans) - out)], repr(text[:160]))
    return {k: (round(hit[k] / max(got[k], 1), 3), round(hit[k] / max(want[k], 1), 3), want[k]) for k in KINDS}


def trials(seed: int, sentences: int) -> list[tuple[str, list[tuple[int, int, str]], Lexicon]]:
    maker = Maker(seed)
    return [(*maker.sentence(), maker.world.lexicon) for _ in range(sentences)]


if __name__ == "__main__":
    to = Path(sys.argv[1]) if len(sys.argv) > 1 else WEIGHTS
    fitted = fit()
    to.write_text(json.dumps(fitted, ensure_ascii=False, indent=0) + "\n")
    print(len(fitted), accuracy(fitted, trials(SEED + 1, 3000)))
