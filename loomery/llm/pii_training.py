"""Labelled sentences, made from a grammar, from which the model of ``pii`` is trained."""

from __future__ import annotations

import re

import numpy as np

#: Given names that mark a candidate, common ones of several countries; a parameter of the model.
GIVEN = (
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher Lisa Matthew Nancy Anthony Betty Mark Sandra "
    "Donald Ashley Steven Kimberly Andrew Emily Kenneth Michelle Joshua Carol Kevin Amanda Brian Melissa George Deborah Edward Stephanie Ronald Rebecca Timothy Sharon Jason Laura Jeffrey Cynthia Ryan "
    "Peter Sabine Michaela Thorsten Uwe Petra Andreas Katrin Wolfgang Jürgen Monika Dieter Heike Matthias Birgit Markus Claudia Frank Ulrike Pierre Marie Jean Isabelle Philippe Nathalie Laurent Sandrine "
    "Nicolas Valérie Olivier Sylvie Thierry Aurélie Carlos Maria José Carmen Miguel Isabel Javier Pilar Francisco Dolores Alejandro Raquel Giulia Marco Francesca Luca Alessandro Chiara João Inês Pieter "
    "Sanne Ahmed Fatima Wei Mei Hiroshi Yuki Olga Dmitri Ivan Katarzyna Piotr Ewa Björn Astrid Lars Nikolai Samira Hassan Aisha Kwame Chidi Lena Oskar"
).split()
#: More given names of many countries. They mark a candidate as those do, but the sentences for training are not made of them.
MORE_GIVEN = (
    "Aaron Abigail Adam Adrian Adriana Agnes Agnieszka Aiden Alan Alana Albert Alberto Alejandra Alexander Alexandra Alexis Alfred Alice Alicia Alison Allison Alma Amelia Amelie Amina Amir Amy Ana Anaïs André Andrea Andrés Angela Angelina Anika Anita Anja Anna Anne Annika Annette Antoine Anton Antonia Antonio Antonella Arjun Arthur Arturo Audrey Axel "
    "Beatrice Beatriz Ben Benedikt Benjamin Bernd Bernhard Bianca Bilal Bruno Camila Camille Carina Carla Carlo Carolina Caroline Catarina Catherine Cecilia Céline Chen Chloé Chloe Christian Christiane Christina Christine Christoph Clara Clément Colin Connor Cornelia Cristina Dagmar Damien Dana Daniel Daniela Danielle Dario David Davide Denis Dennis Derek Diana Diego Dirk Dominic Dominik Dorothea Duarte Dylan "
    "Edith Eduardo Elena Eleanor Eleonora Elias Elisa Elisabeth Ella Ellen Emil Emilia Emilio Emma Emmanuel Enrique Eric Erik Erika Esther Ethan Eugene Eva Evelyn Fabian Fabio Federica Federico Felipe Felix Fernanda Fernando Filip Fiona Florian Franz Frederick Frederik Frieda Friedrich Gabriel Gabriela Gabriele Gareth Georg Gerhard Gianluca Giorgio Giovanni Giuseppe Gonzalo Graham Gregor Gregory Greta Guillaume Günter Gustav "
    "Hanna Hannah Hans Harald Harold Harry Helen Helena Helga Hélène Helmut Hendrik Henri Henrik Henry Hugo Ian Ibrahim Ida Ignacio Igor Ilse Imran Ines Inga Ingrid Irene Irina Iris Isaac Isabella Isla Ismail Jack Jacob Jacqueline Jakob Jakub James Jan Jana Jane Janet Janine Jasmin Jasper Jens Jeroen Joachim Joana Joanna Joaquín Jochen Johan Johanna Johannes Jonas Jonathan Jorge Josef Josefine Joyce Juan Juana Judith Julia Julian Juliana Julie Julien Julio Jun Justin "
    "Karim Karin Karl Karolina Kasper Katharina Katherine Kathleen Katja Kayla Keith Kerstin Kim Klaus Konrad Kristin Kyle Larissa Laila Lea Léa Leila Leo Leon Leonard Leonie Leonor Liam Lidia Lieke Lina Linus Lorenz Lorenzo Lotte Louis Louise Luca Lucas Lucía Lucia Lucie Ludwig Luis Luisa Lukas Luz Maarten Madison Magdalena Malik Manfred Manon Manuel Manuela Marcel Marcin Marcus Margaret Margarida Margot Maria Mariana Marina Mario Marion Marta Martha Martin Martina Mateo Mateus Mathieu Mathilde Matilde Matteo Max Maximilian Maya Megan Mehmet Melanie Mia Michał Michel Mikael Mila Milan Mina Mirjam Mohamed Mohammed Moritz Mustafa "
    "Nadia Nadine Naomi Natalia Natalie Natasha Nele Niamh Nicholas Nicola Nicole Niels Niklas Nils Nina Nora Norbert Nuno Octavio Oliver Olivia Omar Orla Oscar Otto Owen Pablo Paola Pascal Patrícia Patrick Paul Paula Pauline Pavel Pedro Penelope Philip Philipp Phoebe Piero Priya Rafael Rahul Rainer Ralf Ramona Raphaël Raúl Rebekka Regina Reinhard Renate Ricardo Riccardo Rita Roberta Roberto Robin Rodrigo Roger Roland Roman Romain Rosa Rosalie Rosario Roxana Rubén Rui Rupert Ruth "
    "Sabrina Salma Salvatore Samantha Samuel Sander Sara Sébastien Sebastian Selma Sergio Shane Siegfried Silke Silvia Simona Simone Sofia Sofie Solange Sophia Sophie Stefan Stefanie Stefano Stephan Stephen Stuart Susana Susanne Svenja Svetlana Tamara Tania Tanja Tatiana Teresa Theo Theodor Theresa Thiago Tiago Tim Tina Tobias Tom Tomás Tomasz Torsten Trevor Tristan Ulrich Ursula Valentin Valentina Valeria Vanessa Vera Verena Veronica Vicente Victor Vincent Violeta Volker Walter Wendy Werner Wilhelm Xavier Yannick Yasmin Youssef Yusuf Yvonne Zoe Zofia"
).split()
_SURNAME = (
    "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Martin Thompson White Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Hill Green Adams Baker Nelson "
    "Carter Mitchell Turner Phillips Campbell Parker Evans Edwards Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Neumann Zimmermann Krüger Hofmann "
    "Dubois Bernard Durand Leroy Moreau Simon Laurent Lefebvre Roux Fournier Girard García Fernández González Rodríguez López Martínez Sánchez Pérez Gómez Ruiz Rossi Russo Ferrari Esposito Bianchi Romano "
    "Nowak Wiśniewska Johansson Andersson Nilsson Hansen Larsen Jansen Bakker Visser Tanaka Sato Nguyen Khan Okafor Mensah Haddad Ivanova Petrov"
).split()
_ONSET = "b c d f g h j k l m n p r s t v w y z br ch cr dr fl fr gr kl kr pr sh st th tr sch ph qu bl gl".split()
_VOWEL = "a e i o u a e i o a e ie ei ia io ea y ö ü é á í au ou".split()
_CODA = "n r s l t m k d n r s l ck ng nd rt st rs ns ld tz x ff v z rn lm gh th sk".split()
_TOWN = "Ashburn Dunmore Northvale Westbridge Carlow Milford Easton Harwick Kronberg Seefeld Rothenau Waldkirch Bergheim Saint-Denis Montclair Beaulieu Aubervilliers Valdoro Puerto_Claro Santa_Rita Castelnuevo Fiorenza Port_Hale New_Haven Old_Forge".split()
_STREET = "Main Elm Oakwood Birch Hazel Victoria Albert Windsor Abbey Castle Garden River Highland Sunset Meadow Forest Spring Prospect Chestnut Walnut Lakeview Bridge Union Franklin Jefferson".split()
_KIND = "Street St. St Road Rd Avenue Ave Lane Drive Court Close Row Way Place Square Terrace Boulevard".split()
_GERMAN = "Goethestraße Schillerstr. Bergstraße Waldweg Wiesenweg Birkenallee Kastanienallee Dorfplatz Rathausplatz Lange_Gasse Uferstraße Mozartstr. Parkallee Feldweg".split()
_DOMAIN = "posteo.test inbox.invalid webpost.test northmail.invalid uni-west.test shop.acme.test cloudbox.localhost briefe.invalid correo.test courrier.invalid team.widgets.test".split()

NAMED = [
    "Kind regards,\n{N}", "Many thanks,\n{N}", "Kind regards,\n{N}\n{A}\nMobile {P}", "my sister {N} comes to fetch it", "Lena's cousin {N} is here", "painted by {N}", "sent by {N}.", "sent by {N} on Monday. {f}", "The form was checked by {N}.", "Did {N} reply?", "{N} called twice. {f}", "for {N}", "to {N}: {f}",
    "{N} and {N} think that {f}", "thanks to {N}, {f}", "{N}; {N} is informed", "{N}, {N} and {N} were there", "{N} told us that {f}", "{N} wants to cancel the booking under {E}", "Participants: {N}, {N}", "Ich bin {N}, meine Handynummer lautet {P}.", "Soy {N}.", "Merci, {N}", "Frau {N} und Herr {N} kommen.", "wait for {N} at the door", "call {N} at once",
    "Entry: {N}, {A}, {P}, {I}.", "{N}; {N} and {N} agreed", "we asked {N} for the key", "My friend {N} will come along.", "the wife of {N} called, {f}", "please greet {N} from me", "{N} has moved to {A}.", "copy to {N}", "{N} is ill today, so {f}", "hand it to {N} or to {N}", "my boss {N} and I agree", "Mein Name: {N}", "je suis {N}, {f}", "me llaman {N}", "Kunde {N} wartet.",
    "Hello, this is {N} writing again.", "{N} will be our guest on Friday.", "I talked to {N} yesterday, and {f}", "Could someone pass this on to {N}, please?", "{N} and {N} have both signed.", "As {N} put it, {f}",
    "the caller was {N} and the callback number is {P}", "Soy {N}, mi móvil: {P}.", "Hier spricht {N}, erreichbar unter {P}.", "Ici {N}, j'habite {A}.", "In an emergency ring {N} under {P}.", "The new owner of the account: {N} ({P})",
    "{T} {N} has a mailbox at {E} now", "Der Brief an {T} {N}, {A}, kam zurück.", "her brother {N} holds the card {I}", "{N} presented the passport {I}", "{N} can be found at {E} and also at {P}",
    "delete the whole profile of {N} ({E})", "From: {N} <{E}>\n{f}", "Person: {N}; home: {A}; mobile: {P}; number: {I}", "is {N} still with you?", "Cheers,\n{N}", "Best wishes\n{N}\n{A}\nPhone: {P}", "Viele Grüße\n{N}",
    "Cordialement,\n{N}", "Un saludo,\n{N}", "{N} / {E} / {P}", "{N}\n{E}", '{{"name": "{N}", "email": "{E}", "phone": "{P}"}}', '{{"customer": "{N}", "address": "{A}"}}', "Fragen Sie doch {N}.", "Il faut prévenir {N} demain.", "Hay que avisar a {N}.",
    "{T} {N} recommended this to {T} {N}.", "{T} {N} wrote back.", "Author: {N}", "assigned to {N} since Monday", "it was {N}'s idea", "{N}, {A}", "{N} {P}", "{N}: {f}", "customer {N} complained", "User {N} wants a refund.", "{N} (born in May) lives at {A}.",
]
OTHER = [
    "mails go to {E} only", "Use {E} for the receipt.", "Her private mail is {E}.", "He changed {E} into {E} last week.", "Mi DNI: {I}, mi correo: {E}", "Vous pouvez répondre à {E} ou au {P}.", "Liefern Sie bitte nach {A}, Telefon {P}.",
    "Ring me on {P} in the evening.", "mobile {P}", "The customer's home is {A}, second floor.", "Deliver it to {A} instead.", "We have moved to {A}.", "Our office: {A}.", "Her tax number is {I}.", "insurance number {I} was checked",
    "Wohnhaft: {A}", "Mi dirección es {A}.", "Mon adresse est {A}.", "Phone: {P}", "fax {P}", "Ausweisnummer {I}", "{P}", "{A}", "{E}", "Teléfono: {P}", "Telefon: {P}", "social security number {I}", "SSN {I}", "passport no. {I}", "mail: {E}", "id card {I} and phone {P}",
    "The number of the identity card is {I}.", "numéro de sécurité sociale {I}", "Steuer-ID {I}", "NIF {I}", "mi número de identificación es {I}", "social security no. {I}", "Su pasaporte: {I}", "mon passeport est le {I}", "Meine Passnummer ist {I}.", "National insurance: {I}.", "reach us under {P} or {E}", "he lives at {A} with two cats", "ship to: {A}", "address={A}", "my id is {I}", "verified with {I}", "Passport {I} expires soon.", "The passport ({I}) is valid.", "Tax id: {I}", "her tax number, {I}, is new", "identity number {I}", "Número del DNI: {I}", "ID {I} is hers.", "the ID {I} belongs to him", "Entry: {A}, {P}, {I}.", "{P}, {I}", "{A}, {I}", "license and passport {I}", "from {A} to {A}",
]
NEGATIVE = [
    "See page {d2}, table {d1}, in the {X} Handbook.", "Please upgrade libfoo@{d1}.{d2}.{d1} today.", "The {X} Street edition is out of print.", "Bill {d4}-{d4}-{d2} is settled.", "Lot {d4} {d4} {d4} was sold.", "Purchase {d10} left the depot as 1Z{d4}{d4}.",
    "We run {d4}.{d2}.{d4} in production.", "{d3} calls to {X} failed.", "At 2024-{m}-{m} 1{d1}:{m}:{m} the job {d1}.{d1}.{d1}.{d1} stopped.", "{X} Studio and {X} Cloud are tools.", "Case 0{d1}-{d4}-{d4} was closed.", "Ping @{x} about it.", "{X} Portal needs 10.0.{d2}.{d1}.",
    "{X} Park is the name of a release.", "Victoria is a server, and Georgia a cluster.", "The Florence build broke the Lyon branch.", '{{"state": "{w} {w}", "rows": {d3}, "key": "AB-{d5}"}}', "The {w} has {d5} lines since 2024-{m}-{m}.", "{X} v{d1}.{d2}.{d2}", "2024-{m}-{m} 1{d1}:{m} WARN {X} QX-{d5}",
    "{X} Bridge was replaced by {X} Tower.", "part number {d4}-{d4}-{d4}", "tracking code {d4} {d4} {d2}", "invoice {d8}", "Quote {d4}-{d2}-{d4} was sent.", "bill {d4}-{d2}-{d4}", "order no. {d9}", "serial {d4}{d4}", "Die {G} der {G} zeigt das {G}.", "Das {G} hält den {G} und die {G} mit dem {G}, weil der {G} fehlt.", "Jede {G} braucht ein {G}; nach der {G} kommt das {G}.", "{G} und {G} der {G}", "Zur {G} gehört das {G}, beim {G} nicht.", "Im {G} liegt ein {G}, am {G} keiner.", "Zum {G} hilft {G} dem {G}, vom {G} her.", "{f} Vom {G} zum {G}.", "{F}", "{F} {F}", "{F} {f}", "Wo ist der {G} des {G}?", "Eine {G} ohne {G} hilft dem {G} nicht.", "Reference: {d2} {d3} {d3} {d3}", "the {X} Console shows the {X} Index", "Our Sales Team met the {X} Group.",
    "Die neue Vorlage im {X} Archiv ist fertig.", "Le Guide {X} est en ligne.", "El Panel {X} ya funciona.", "Street Food Market is a project", "Mail Server, Phone Book and Address List are menus.", "Open Source Week starts at {d2}.", "[{X}] {f}", "# {X} Notes", "{X} Lane Keeper has {d2} stars", "Cedar Court Runner is a game",
    "row {d5} of {d5}", "{d4}-{m}-{m}", "{d2}:{m}:{m}", "build {d8} ok", "commit {d4}{d4}", "sku {d3} {d3} {d3}", "the room {d3} in {X} House", "account no {d10} is closed", "code {d6}", "PIN {d4}",
]
_FILL = {
    "en": "this that some many every new old small large quick open closed document table button error update reason budget travel plan kitchen window server answer question summary review changes keeps stops begins shows needs moves helps allows early late often never soon again with without about between among until since before during from into onto upon and but or so if then when while".split(),
    "de": "dieser diese dieses jede viele neue alte kleine große schnell Tabelle Fehler Grund Fenster Frage Antwort Zusammenfassung Prüfung Ordner Kasse Rechnung Garten Straße Zeit Montag Woche ändert hält beginnt zeigt braucht hilft erlaubt früh spät oft nie bald wieder mit ohne über zwischen bis seit vor während von aus auf und aber oder wenn dann als weil".split(),
    "fr": "ce cette ces chaque plusieurs nouveau ancien petite grande rapide document erreur raison fenêtre question réponse résumé contrôle dossier caisse temps lundi semaine change garde commence montre demande aide permet tôt tard souvent jamais bientôt encore avec sans sur entre depuis avant pendant de du et mais ou si quand parce".split(),
    "es": "este esta estos cada muchos nuevo antiguo pequeña grande rápido documento error razón ventana pregunta respuesta resumen control carpeta caja tiempo lunes semana cambia guarda empieza muestra necesita ayuda permite pronto tarde nunca otra vez con sin sobre entre desde antes durante de y pero o si cuando porque".split(),
}
_GERMAN_NOUNS = (
    "Haus Garten Schule Lehrer Tisch Stuhl Lampe Küche Zimmer Fenster Tür Dach Keller Auto Zug Bahnhof Flughafen Schiff Hafen Brücke Fluss See Berg Wald Baum Blume Vogel Hund Katze Pferd Kuh Brot Käse Milch Apfel Birne Kaffee Tasse "
    "Teller Löffel Messer Gabel Buch Heft Stift Papier Brief Zeitung Bild Farbe Musik Lied Film Spiel Ball Mannschaft Verein Arbeit Beruf Chef Kollege Büro Vertrag Geld Bank Konto Preis Kauf Verkauf Laden Markt Ware Kunde Firma "
    "Gesetz Recht Pflicht Frage Antwort Grund Zweck Ziel Weg Mittel Anfang Ende Mitte Teil Menge Zahl Summe Größe Länge Breite Höhe Zeit Tag Nacht Morgen Abend Woche Monat Jahr Sommer Winter Regen Schnee Wind Sonne Mond Stern Welt "
    "Land Stadt Dorf Platz Ecke Karte Plan Reise Gast Koffer Hotel Zelt Feuer Wasser Luft Erde Stein Holz Metall Glas Kraft Motor Rad Werk Gerät Maschine Technik Rechner Programm Datei Ordner Zugang Schlüssel Schloss Meldung Prüfung"
).split()
_NOUN = "Portal Engine Suite Board Console Monitor Planner Studio Cloud Index Cache Router Viewer Hub Gateway Ledger Relay Theme Kitchen Release Report Team Service Queue Office Room Project".split()


class Maker:
    """``background`` are sentences without personal details, from any text of the kind to be read."""

    def __init__(self, seed: int = 11, background: list[str] | None = None) -> None:
        self.rng = np.random.default_rng(seed)
        self.background = background or []

    def of(self, items):
        return items[int(self.rng.integers(0, len(items)))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def digits(self, n: int) -> str:
        return "".join(str(d) for d in self.rng.integers(0, 10, n))

    def syllables(self) -> str:
        """A word that could be a name: two or three syllables of random letters, so that no ending tells names apart."""
        out = ""
        for _ in range(2 if self.chance(0.6) else 3):
            out += ("" if not out and self.chance(0.2) else self.of(_ONSET)) + self.of(_VOWEL) + (self.of(_CODA) if self.chance(0.4) else "")
        return (out + (self.of(["a", "o", "i", "er", "en", "son", "ski", "ez"]) if self.chance(0.25) else "")).capitalize()

    def surname(self) -> str:
        name = self.of(_SURNAME) if self.chance(0.3) else self.syllables()
        return name if self.chance(0.88) else f"{name}-{self.of(_SURNAME) if self.chance(0.5) else self.syllables()}"

    def given(self) -> str:
        """Half of them are not in the list of given names, as most of the world's are not."""
        return self.of(GIVEN) if self.chance(0.5) else self.syllables()

    def name(self) -> str:
        first, last = self.given(), self.surname()
        form = self.rng.random()
        initial = self.of("ABCDEFGHIJKLMNOPRSTUVWYZ")
        if form < 0.52:
            out = f"{first} {last}"
        elif form < 0.6:
            out = f"{first} {initial}. {last}"
        elif form < 0.7:
            out = f"{last}, {first}"
        elif form < 0.77:
            out = self.given()
        elif form < 0.84:
            out = f"{initial}. {last}"
        elif form < 0.92:
            out = f"{first} {self.of(['von', 'van', 'de', 'della', 'del', 'van der', 'da', 'di', 'von der', 'de la'])} {last}"
        else:
            out = f"{first} {self.of(GIVEN)} {last}"
        case = self.rng.random()
        return out.upper() if case < 0.07 else out.lower() if case < 0.2 else out

    def email(self) -> str:
        first, last = self.given().lower(), self.surname().lower()
        local = self.of([f"{first}.{last}", f"{first}_{last}", f"{first}-{last}", f"{first[0]}{last}", f"{last}{self.digits(2)}", f"{first}+{self.of(_FILL['en'])}", last])
        domain, form = self.of(_DOMAIN), self.rng.random()
        if form < 0.06:
            return f"{local} at {domain.replace('.', ' dot ')}"
        if form < 0.1:
            return f"{local} (at) {domain.replace('.', ' (dot) ')}"
        if form < 0.14:
            return f"{local}[at]{domain}"
        if form < 0.18:
            return f"{local} @ {domain}"
        whole = f"{local}@{domain}"
        return whole.upper() if form < 0.28 else whole

    def phone(self) -> str:
        """National and international spellings of several countries."""
        d = self.digits
        mid, n = self.of("23456789") + d(2), self.of("23456789") + d(2)
        us = f"{n}{{0}}{mid}{{1}}{d(4)}"
        return self.of(
            [f"+1 {us.format(' ', ' ')}", f"001{n}{mid}{d(4)}", f"({n}) {mid}-{d(4)}", us.format("-", "-"), us.format(".", "."), f"+1-{us.format('-', '-')}", f"+49 {d(2)} {d(5)} {d(3)}", f"0{d(2)}/{d(8)}", f"0{d(3)}/{d(7)}", f"+49 1{d(2)} {d(7)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}"]
            + [f"07{d(3)} {d(3)} {d(3)}", f"07{d(3)} {d(6)}", f"+44 7{d(3)} {d(6)}", f"+44 20 {d(4)} {d(4)}", f"0{d(3)} {d(7)}", f"+34 6{d(2)} {d(3)} {d(3)}", f"6{d(2)} {d(3)} {d(3)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+39 3{d(2)} {d(7)}", f"+31 6 {d(8)}", f"{mid}-{d(4)}"]
        )

    def identity(self) -> str:
        """Public formats: social security, tax, insurance, passport and identity card numbers."""
        d, letter, two = self.digits, self.of("ABCDEFGHJKLMNPRSTUVWXYZ"), self.of("ABCEGHJKLMNOPRSTWXYZQ") + self.of("ABCEGHJKLMNPRSTWXYZQ")
        return self.of([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", d(9), f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{two}{d(6)}{letter}", f"{two} {d(2)} {d(2)} {d(2)} {letter}", f"{two}{d(7)}", f"{letter}{d(8)}", f"{letter}{d(7)}", f"{d(8)}-{letter}", f"{d(8)}{letter}"])

    def address(self) -> str:
        town = self.of(_TOWN).replace("_", " ")
        n, form = str(self.rng.integers(1, 190)), self.rng.random()
        sep = ", " if self.chance(0.9) else "\n"
        street = f"{self.of(_STREET) if self.chance(0.6) else self.syllables()}{' ' + self.of(_STREET) if self.chance(0.1) else ''}"
        town = town if self.chance(0.5) else self.syllables() + (" " + self.of(["Falls", "Bay", "Hills", "am See", "sur Mer"]) if self.chance(0.15) else "")
        zip_ = self.digits(5) if self.chance(0.8) else self.digits(4)
        if form < 0.5:
            out = f"{n}{self.of(['', '', 'B', 'a'])} {street} {self.of(_KIND)}"
            if self.chance(0.08):
                out = out.lower()
            if self.chance(0.25):
                return f"{out}, {self.of(['Apt', 'Suite', 'Unit', 'Apartment'])} {self.rng.integers(1, 90)}{sep}{town}{'' if self.chance(0.3) else ' ' + zip_}"
            out = f"{out}{sep}{town}{'' if self.chance(0.6) else ' ' + zip_}"
            return f"{self.of(['Flat', 'Apt'])} {self.rng.integers(1, 60)}, {out}" if self.chance(0.2) else out
        if form < 0.7:
            ending = self.of(["straße", "str.", "weg", "allee", "gasse", "platz", "ufer"])
            street = self.of(_GERMAN).replace("_", " ") if self.chance(0.3) else f"{self.syllables()}{ending}" if self.chance(0.8) else f"{self.of(['Am', 'Im', 'An der'])} {self.syllables()}{self.of(['grund', 'hof', 'tor', 'bach', ''])}"
            return f"{street} {n}{self.of(['', 'a', 'c'])}{sep}{zip_} {town}"
        if form < 0.85:
            way = f"{self.of(['de la', 'du', 'des', 'de'])} {self.syllables()}" if self.chance(0.7) else self.of(["Jean Jaurès", "de la Gare", "de Paris"])
            return f"{n}{self.of(['', ' bis', ''])} {self.of(['rue', 'avenue', 'boulevard', 'quai', 'chemin'])} {way}{sep}{zip_} {town}"
        way = f"{self.of(['Calle', 'Avenida', 'Plaza', 'Paseo', 'Via', 'Piazza', 'Rua'])} {self.of(['', 'de la ', 'del ', 'de '])}{self.syllables()} {n}"
        return f"{way}, {self.of(['bajo', 'piso 2', 'piso 5', '3.º A', '1.º C', zip_])}{sep}{town}"

    def filler(self) -> str:
        if self.background and self.chance(0.8):
            text = self.blurred(self.of(self.background), 0.05)
            case = self.rng.random()
            return text.upper() if case < 0.08 else text.lower() if case < 0.12 else text
        language = self.of(list(_FILL))
        words = _FILL[language] + (_GERMAN_NOUNS[: len(_FILL[language]) // 2] if language == "de" else [])
        out = [self.of(words) for _ in range(int(self.rng.integers(5, 13)))]
        if self.chance(0.3):
            out.insert(len(out) // 2, self.of([f"tool {self.invented()}", f"{self.invented()} version {self.digits(1)}.{self.digits(2)}.{self.digits(2)}", f"(QX-{self.digits(5)})", f"({self.digits(5)} lines)", f"AB-{self.digits(5)}"]))
        text = " ".join(out)
        text = text[0].upper() + text[1:] + self.of([".", ".", ".", "!", "", ";"])
        return text.upper() if self.chance(0.05) else text

    def blurred(self, text: str, share: float = 0.15) -> str:
        """Some of the ordinary words are ones never seen, as in the texts to be read."""
        return re.sub(r"\b[a-zà-ÿ]{3,}\b", lambda m: self.syllables().lower() if self.chance(share) else m[0], text)

    def invented(self) -> str:
        """The name of a thing: made as family names are, so that only the words around it tell."""
        return self.syllables() if self.chance(0.7) else f"{self.syllables()} {self.of(_NOUN)}"

    def document(self) -> tuple[str, list[tuple[int, int, str]]]:
        text, spans = "", []
        for _ in range(int(self.rng.integers(2, 5))):
            form = self.rng.random()
            template = self.of(NAMED) if form < 0.4 else self.of(OTHER) if form < 0.6 else self.of(NEGATIVE) if form < 0.8 else "{f}"
            if text:
                text += self.of([" ", " ", " ", "\n"])
            for part in re.split(r"(\{\w+\})", template.replace("{{", "\1").replace("}}", "\2")):
                slot = part[1:-1] if part.startswith("{") else ""
                kind = {"N": self.name, "E": self.email, "P": self.phone, "I": self.identity, "A": self.address}.get(slot)
                if kind:
                    value = kind()
                    spans.append((len(text), len(text) + len(value), slot))
                    text += value
                elif slot == "f":
                    text += self.filler()
                elif slot == "F":
                    text += self.filler().upper()
                elif slot == "T":
                    text += self.of("Dr. Frau Herr Mr. Ms. Mrs. Prof. Señora Mme Mr Señor Monsieur Miss".split())
                elif slot == "X":
                    text += self.invented()
                elif slot == "G":
                    text += self.of(_GERMAN_NOUNS) if self.chance(0.7) else self.of(_GERMAN_NOUNS) + self.of(_GERMAN_NOUNS).lower()
                elif slot == "x":
                    text += self.invented().lower()
                elif slot == "w":
                    text += self.of(_FILL["en"])
                elif slot == "m":
                    text += f"{int(self.rng.integers(1, 13)):02d}"
                elif slot[:1] == "d":
                    text += self.digits(int(slot[1:]))
                else:
                    text += self.blurred(part.replace("\1", "{").replace("\2", "}"))
        return text, spans


def documents(count: int, seed: int = 11, background: list[str] | None = None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    maker = Maker(seed, background)
    return [maker.document() for _ in range(count)]
