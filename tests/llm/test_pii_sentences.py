"""Problem 5 on sentences written by hand, in eight languages: what must be found, and what must be left alone."""

from collections import Counter

from lumenlake.llm import pii as P

FOUND = """
NAME: My name is John Smith
NAME: I met Anna Schmidt yesterday
NAME: Hi, I'm Peter Novak
NAME: Contact Maria Gomez for details
NAME: Dr. Henry Wallace performed the surgery
NAME: Happy birthday Emily Stone!
NAME: Interview with Laura Keller
NAME: Yesterday David Thompson opened the new exhibition
NAME: We had dinner at Sarah O'Brien's place
NAME: Congratulations Thomas Reed, you earned it
NAME: thanks to michael turner for lending us his van
NAME: portrait of Elizabeth Moore in her workshop
NAME: This is R. Patterson from the second floor
NAME: Signed, Jennifer L. Brooks
NAME: Patterson, George was absent today
NAME: music by Kate Hudsonfield
NAME: A letter from Mary Ann Fletcher
NAME: Ask William Carter about the tickets
NAME: MY NEIGHBOUR IS CALLED ROBERT HARGREAVE
NAME: Please welcome Prof. Daniel Whitmore
NAME: Me llamo Carlos Ruiz
NAME: Ayer conocí a Javier Moreno en la feria
NAME: Gracias a Lucía Fernández por las fotos
NAME: Fotos de Elena Martín
NAME: La doctora Carmen Ortega nos atendió
NAME: Hablamos con José Luis Navarro sobre el barrio
NAME: Entrevista con Pilar Castaño
NAME: Feliz cumpleaños, Diego Herrera
NAME: Mi hermano Pablo Serrano cocina los domingos
NAME: Soy Isabel Vidal y vivo en el norte
NAME: O meu nome é João Pereira
NAME: Obrigado a Beatriz Almeida pelo apoio
NAME: Conheci o Pedro Carvalho no concerto
NAME: Texto por Mariana Lopes
NAME: Entrevista com Rui Teixeira
NAME: A professora Inês Monteiro chegou cedo
NAME: Fotografia de Tiago Barbosa
NAME: Falei ontem com Ana Sousa
NAME: Je m'appelle Claire Dubois
NAME: Merci à Nicolas Lefèvre pour son aide
NAME: Hier j'ai vu Camille Moreau au marché
NAME: Photos de Julien Garnier
NAME: Le docteur Philippe Renaud est en congé
NAME: Mon voisin Jean Marchand répare des vélos
NAME: Un dessin signé Sophie Lambert
NAME: Bon anniversaire Pierre Fontaine !
NAME: Ich heiße Hans Müller
NAME: Gestern traf ich Sabine Hoffmann am Bahnhof
NAME: Danke an Stefan Krüger für das Licht
NAME: Mein Name ist Petra Vogel
NAME: Herr Klaus Zimmermann hat angerufen
NAME: Fotos von Lukas Bergmann
NAME: Meine Nachbarin Ursula Beck singt im Chor
NAME: Geschrieben von K. Lindemann
NAME: Mi chiamo Giulia Bianchi
NAME: Ieri ho incontrato Marco Ferretti in piazza
NAME: Grazie a Francesca Conti per il pane
NAME: Foto di Alessandro Rinaldi
NAME: La signora Paola Marchetti abita qui
NAME: Un disco di Luca Santini
NAME: Il mio amico Matteo Galli suona il basso
NAME: Меня зовут Иван Петров
NAME: Вчера я встретила Ольгу Смирнову, это Ольга Смирнова из школы
NAME: Спасибо Алексею, фото: Дмитрий Соколов
NAME: Интервью: Екатерина Волкова о новом фильме
NAME: Моя подруга Анна Кузнецова печёт хлеб
NAME: Иванов Сергей опоздал на урок
NAME: 私の名前は田中太郎です
NAME: 佐藤花子さんに会いました
NAME: 撮影：鈴木一郎
NAME: 山本健と申します
EMAIL: Reach us: info@garden-club.example
EMAIL: escribe a marta.gil arroba correo punto es
EMAIL: schreib an otto [at] verein [punkt] de
EMAIL: mail sam(at)post(dot)org
EMAIL: пишите на ivan@pochta.example.ru
PHONE: You can call me on 020 7946 0991
PHONE: Llámame al 612 34 56 78
PHONE: Tel. +49 30 901820
PHONE: Mon portable : 06 12 34 56 78
PHONE: chiamami al 347 123 4567
PHONE: Liga-me para 912 345 678
PHONE: мой телефон 8 (495) 123-45-67
PHONE: 電話は03-1234-5678です
PHONE: text five five five zero one four two
ID_NUMBER: My social security number is 123-45-6789
ID_NUMBER: NI number QQ 12 34 56 C
ID_NUMBER: my driving licence DL-99887766 was stolen
ID_NUMBER: Mi DNI es 12345678Z
ID_NUMBER: o meu CPF é 111.222.333-44
ID_NUMBER: Numéro de sécurité sociale 1 85 05 78 006 084 36
ID_NUMBER: Meine Steuer-ID lautet 12 345 678 901
ID_NUMBER: codice fiscale RSSMRA85T10A562S
ID_NUMBER: Мой СНИЛС 112-233-445 95
ID_NUMBER: マイナンバーは1234 5678 9012です
ID_NUMBER: 身份证 110101199003078515
ADDRESS: I live at 12 Baker Street
ADDRESS: Vivo en la calle Mayor, 15
ADDRESS: Moro na Rua Augusta, 230
ADDRESS: J'habite 8 rue Victor Hugo
ADDRESS: Ich wohne in der Lindenstraße 12
ADDRESS: Abito in via Garibaldi 7
ADDRESS: Живу на улице Пушкина, дом 10
ADDRESS: 東京都港区赤坂1-9-1に住んでいます
""".strip().split("\n")

CLEAN = """
The Natural History Museum was closed on Monday
We walked from Baker Street to the river
New York and Los Angeles are far apart
Team Anderson lost the final
Our order at Miller & Sons arrived late
The Grand Hotel has 250 rooms and 3 pools
In London Peter was late again
May the best cook win
Grace and patience are needed here
Paris, Rome and Berlin in ten days
I bought a Canon lens and a Nikon body
Happy New Year everyone!
Follow @peter_novak for more
The film runs 128 minutes at 24 fps
Version 10.2.13 was released in 2023
ISBN 978-3-16-148410-0
We sold 1,250,000 copies
Order 8841-2231 has shipped
Invoice 20240117 is paid
The score was 3-2 after 90 minutes
El Museo del Prado abre a las diez
Calle Mayor estaba llena de gente
Buenos días a todos desde Sevilla
El Hotel Santa Isabel tiene terraza
O Rio Tejo brilha ao fim da tarde
A Praia da Rocha fica longe
La Tour Eiffel brille la nuit
Le Café de la Gare est fermé
Nous étions trente dans la salle
Der Berliner Dom war geschlossen
Am Montag fahren wir in die Berge
Guten Morgen aus Hamburg
Die Deutsche Bahn hatte Verspätung
Il Teatro alla Scala era pieno
Buon Natale a tutti
Piazza Navona di notte
Красная площадь была закрыта
Большой театр открыл сезон
С новым годом, друзья
東京タワーの写真です
今日は市場に行きました
友だちと魚を食べました
""".strip().split("\n")


def test_recall_and_precision_of_every_type():
    right, wrong, missed = Counter(), [], []
    for line in FOUND:
        kind, _, text = line.partition(": ")
        found = [k for *_, k in P.find(text)]
        right[kind] += kind in found
        missed += [] if kind in found else [line]
        wrong += [(text, k) for k in found if k != kind]
    for text in CLEAN:
        wrong += [(text, k) for *_, k in P.find(text)]
    wanted = Counter(line.partition(":")[0] for line in FOUND)
    assert all(right[k] >= 0.9 * n for k, n in wanted.items()), missed
    assert len(wrong) <= 0.1 * sum(right.values()), wrong


def test_spans_are_names_and_no_more():
    for text, name in [("Contact Maria Gomez for details", "Maria Gomez"), ("Happy birthday Emily Stone!", "Emily Stone"), ("Ich heiße Hans Müller", "Hans Müller"), ("私の名前は田中太郎です", "田中太郎")]:
        assert [text[a:b] for a, b, _ in P.find(text)] == [name]


def test_long_texts_take_time_in_proportion():
    import time

    part = "Thanks to Maria Gomez and Peter Novak of 12 Baker Street, call 020 7946 0991 or write to a@b.example; J. Smithson taught me this. "
    seconds = []
    for n in (500, 4000):
        text, begun = part * n, time.time()
        found = P.find(text)
        seconds.append(time.time() - begun)
        assert len(found) >= 5 * n
    assert len(part * 4000) > 500_000 and seconds[1] < 20 * max(seconds[0], 0.05)
