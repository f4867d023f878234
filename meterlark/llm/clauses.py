"""Training material of problem 4: clauses of everyday subjects, by language and tag.

Sentences are put together from parts, so that a few lines give many wordings. Nothing here is taken
from a table.
"""

from __future__ import annotations

import random

ASK = {
    "en": ["How do I reset the oven timer?", "Why does the printer stop after two pages?", "Where can I park near the station?", "When does the library open on Sundays?", "What does the red light on my router mean?", "Can I return a coat without its receipt?", "Who changes the filter of the pump?", "Is it safe to mix the two paints?", "How much does a yearly ticket cost for students?", "Please explain how the heating works in the annex."],
    "fr": ["Comment régler la minuterie du four ?", "Pourquoi l'imprimante s'arrête-t-elle après deux pages ?", "Où puis-je me garer près de la gare ?", "Quand la bibliothèque ouvre-t-elle le dimanche ?", "Combien coûte un abonnement annuel pour les étudiants ?", "Qui change le filtre de la pompe ?"],
    "de": ["Wie stelle ich die Uhr am Ofen?", "Warum hält der Drucker nach zwei Seiten an?", "Wo kann ich am Bahnhof parken?", "Wann öffnet die Bibliothek am Sonntag?", "Was kostet eine Jahreskarte für Studenten?", "Wer wechselt den Filter der Pumpe?"],
    "es": ["¿Cómo ajusto el reloj del horno?", "¿Por qué se detiene la impresora después de dos páginas?", "¿Dónde puedo aparcar cerca de la estación?", "¿Cuándo abre la biblioteca los domingos?", "¿Cuánto cuesta un abono anual para estudiantes?", "¿Quién cambia el filtro de la bomba?"],
    "zh": ["怎样设置烤箱的定时器？", "为什么打印机打两页就停？", "车站附近哪里可以停车？", "图书馆星期天几点开门？", "学生年票多少钱？", "谁来更换水泵的滤芯？"],
    "ja": ["オーブンのタイマーはどう設定しますか？", "プリンターが二枚で止まるのはなぜですか？", "駅の近くで駐車できる場所はどこですか？", "図書館は日曜日の何時に開きますか？", "学生の年間券はいくらですか？", "ポンプのフィルターは誰が交換しますか？"],
}
TELL = {
    "en": [
        "Hold the left button for three seconds and turn the dial.", "The tray is full, so empty it and try again.", "There is a garage behind the post office.", "It opens at ten and closes at four.", "Yes, within thirty days of the purchase.", "You cannot use the old cable for this.", "The light turns green once it is done.", "Sorry for the wait.", "No, the coat must have its label.", "Do not open the lid while the drum turns.",
        "We change the filter twice a year.", "Never mix them, as the fumes are not safe.", "The machine doesn't take coins.", "If nothing happens, ask the porter for the key of room 12.", "Our shop on Mill Road has spare parts.", "I moved your booking to Friday at nine.", "Press the red switch, then wait for the beep.", "Students pay 240 a year and need no photo.", "You will not be charged for the first week.", "It is not possible to park there on market days, so take the tram.", "Call the desk on weekdays and say your ticket number.", "The water isn't hot before seven.", "Nobody may enter the hall without a badge.", "See page 14 of the booklet for the wiring.", "Tell the driver where you want to get off.", "There is no lift, but the ramp on the left leads up.", "You can't change the date later, so check it twice.", "No, the first coat is dry after an hour.", "The slot doesn't take cards; use coins.", "Do not pull the plug before the fan has stopped.", "Nothing is lost when the power fails.", "Our porter winds the clock every Monday, so come on Tuesday.", "It isn't allowed to bring bikes; leave them in the yard.",
        "We ring twice when the soup is ready.", "I added two chairs to your table.", "Ask the baker and show him slip 31.", "You won't need a stamp for that letter.", "We don't open on holidays, but the kiosk next door does.", "That is the valve for the garden; turn it to the right.", "This part is not sold alone, order the set 17 instead.", "Our bus does not stop there; get off at the mill and walk.", "Without a lid the pot never boils.", "Buy a ticket at the machine and keep it.", "We cannot ship glass by post, so collect it at the counter.", "I can't see a fault in it; set the switch to 2.",
    ],
    "fr": ["Appuyez sur le bouton de gauche pendant trois secondes.", "Le bac est plein, il faut le vider.", "Il y a un garage derrière la poste.", "Elle ouvre à dix heures et ferme à quatre heures.", "Non, le manteau doit avoir son étiquette.", "Vous ne pouvez pas utiliser l'ancien câble.", "Nous changeons le filtre deux fois par an.", "Il n'est pas possible de se garer là les jours de marché, prenez le tram.", "Les étudiants paient 240 par an.", "N'ouvrez pas le couvercle pendant que le tambour tourne.", "L'eau n'est pas chaude avant sept heures.", "Le vieux ticket ne passe plus dans la machine.", "Nous sonnons quand la soupe est prête.", "Non, rien n'est perdu en cas de panne.", "On ne peut pas échanger le verre ; prenez le bon numéro 17.", "Notre bus ne s'arrête pas là, descendez au moulin.", "Vous n'avez pas besoin de timbre.", "J'ai ajouté deux chaises à votre table."],
    "de": ["Halten Sie die linke Taste drei Sekunden lang gedrückt.", "Das Fach ist voll und muss geleert werden.", "Hinter der Post gibt es eine Garage.", "Sie öffnet um zehn und schließt um vier Uhr.", "Nein, der Mantel braucht sein Etikett.", "Das alte Kabel können Sie dafür nicht nehmen.", "Wir wechseln den Filter zweimal im Jahr.", "An Markttagen kann man dort nicht parken, nehmen Sie die Bahn.", "Studenten zahlen 240 im Jahr.", "Öffnen Sie den Deckel nicht, solange sich die Trommel dreht.", "Vor sieben ist das Wasser nicht warm.", "Es gibt keinen Aufzug, aber links eine Rampe.", "Das alte Billett passt nicht mehr in den Automaten.", "Wir läuten, sobald die Suppe fertig ist.", "Nein, das dauert nicht lange.", "Glas kann man nicht umtauschen, nehmen Sie Nummer 17.", "Unser Bus hält dort nicht, steigen Sie an der Mühle aus.", "Sie brauchen dafür keine Marke.", "Ich habe zwei Stühle an Ihren Tisch gestellt.", "Ohne Deckel kocht es nie."],
    "es": ["Mantenga pulsado el botón izquierdo durante tres segundos.", "La bandeja está llena y hay que vaciarla.", "Hay un garaje detrás de la oficina de correos.", "Abre a las diez y cierra a las cuatro.", "No, el abrigo debe llevar su etiqueta.", "El cable viejo no sirve para esto.", "Cambiamos el filtro dos veces al año.", "Los días de mercado no se puede aparcar allí, tome el tranvía.", "Los estudiantes pagan 240 al año.", "No abra la tapa mientras gira el tambor.", "El agua no está caliente antes de las siete.", "El billete viejo ya no entra en la máquina.", "Tocamos la campana cuando la sopa está lista.", "No, no se pierde nada si falla la luz.", "No se puede cambiar el vidrio; tome el número 17.", "Nuestro autobús no para allí, baje en el molino.", "No necesita sello para esa carta."],
    "zh": ["按住左边的按钮三秒钟，然后转动旋钮。", "纸盒满了，清空之后再试。", "邮局后面有一个车库。", "上午十点开门，下午四点关门。", "不行，外套必须带着标签。", "旧电缆不能用在这里。", "我们每年更换两次滤芯。", "集市日那里不能停车，请坐电车。", "学生每年付240元。", "滚筒转动时不要打开盖子。", "七点以前水不热。", "旧车票不能再放进机器。", "汤好了我们会敲钟。", "停电时不会丢失任何东西。", "玻璃不能退换，请拿17号。", "我们的公交车不停那里，请在磨坊下车。", "这封信不需要邮票。"],
    "ja": ["左のボタンを三秒間押してからダイヤルを回します。", "トレイがいっぱいなので空にしてください。", "郵便局の裏に駐車場があります。", "十時に開いて四時に閉まります。", "いいえ、コートにはラベルが必要です。", "古いケーブルは使えません。", "フィルターは年に二回交換します。", "市の立つ日はそこに駐車できません。電車をご利用ください。", "学生は年240円です。", "回っている間はふたを開けないでください。", "七時前はお湯が出ません。", "古い切符は機械に入りません。", "スープができたら鐘を鳴らします。", "停電しても何も失われません。", "ガラスは交換できないので、17番を取ってください。", "バスはそこに止まりません。水車小屋で降りてください。", "この手紙に切手は要りません。"],
}
#: Short answers, of two parts each.
DO = {
    "en": (["Turn it", "Move this", "Put that", "Set it", "Push the knob", "Slide it", "Take it", "Bring them", "Lay this part", "Fold it"], ["left.", "up and then right.", "back in its place.", "to three.", "to the wall.", "out of the box.", "over there.", "on the shelf.", "until it clicks.", "once a day."]),
    "fr": (["Tournez-le", "Mettez ceci", "Posez-le", "Glissez cette pièce", "Apportez-le", "Pliez cela"], ["à gauche.", "sur l'étagère.", "à sa place.", "jusqu'au mur.", "une fois par jour.", "et attendez que la lampe s'éteigne."]),
    "de": (["Drehen Sie es", "Stellen Sie das", "Legen Sie dieses Teil", "Schieben Sie es", "Bringen Sie ihn", "Falten Sie es"], ["nach links.", "auf das Regal.", "an seinen Platz.", "bis zur Wand.", "einmal am Tag.", "und warten Sie, bis die Lampe ausgeht."]),
    "es": (["Gírelo", "Ponga esto", "Déjelo", "Deslice esa pieza", "Tráigalo", "Dóblelo"], ["a la izquierda.", "en el estante.", "en su sitio.", "hasta la pared.", "una vez al día.", "y espere a que se apague la lámpara."]),
    "zh": (["把它", "请将这个", "把那一块", "先把它"], ["向左转。", "放到架子上。", "放回原处。", "推到墙边。", "每天转一次。", "拿出盒子，等灯灭。"]),
    "ja": (["それを", "これを", "その部品を", "まずそれを"], ["左に回します。", "棚に置いてください。", "元の場所に戻します。", "壁まで押してください。", "一日一回動かします。", "箱から出して、ランプが消えるのを待ちます。"]),
}
#: Refusals: (beginnings, endings), every pair of which makes a sentence.
REFUSE = {
    "en": [
        (["I'm afraid I cannot", "We can't", "I am unable to", "We are not able to", "I won't", "Unfortunately we cannot", "Sorry, I can't", "I'm not allowed to", "We do not", "I decline to", "We refuse to", "I have to refuse to", "We are not in a position to", "I would sooner not", "I don't want to", "We choose not to", "I'd better not", "Nobody here may", "We never", "I prefer not to", "I'm not going to", "I am not the one to", "I don't wish to", "I rather not"],
         ["answer that.", "help with this.", "help you with that request.", "comment on this.", "discuss that.", "say anything about this.", "talk about such things.", "respond to this question.", "give any information on that.", "go into this.", "share that here.", "speak about it.", "deal with this.", "provide an answer.", "assist with that.", "advise on such matters.", "take a position on it.", "tell you that.", "be drawn into this.", "get involved in that."]),
        (["That", "This", "Such a thing", "This topic", "Your question", "A matter like this", "That subject"], ["is not something I can help with.", "is outside of what we cover.", "lies beyond my duties.", "is not our business.", "isn't my department.", "is none of our concern.", "will have to stay without an answer.", "is not for me to answer.", "is nothing we discuss.", "is off limits for us.", "goes beyond our remit.", "is a matter we do not touch.", "belongs to others, not to us."]),
        (["I have", "We have", "There is"], ["no answer to that.", "no comment on it.", "nothing to add here.", "nothing more to tell you.", "no statement on this.", "nothing I could say about that."]),
        (["Please", "You had better", "Kindly", "For that, please"], ["contact our office.", "ask another department.", "turn to somebody else.", "look for help elsewhere.", "open a ticket instead.", "understand our position.", "raise it with your own people.", "write to head office.", "file a ticket for this."]),
        (["Thank you for your", "We ask for your"], ["understanding.", "patience.", "cooperation in this."]),
        (["It is our rule", "Our policy is", "We make it a rule"], ["not to speak about this.", "to leave such questions open.", "never to comment.", "not to answer in such cases."]),
    ],
    "fr": [
        (["Nous ne pouvons pas", "Je ne peux pas", "Je ne suis pas en mesure de", "Nous refusons de", "Malheureusement, il est impossible de", "Je ne souhaite pas", "Nous ne voulons pas", "Je préférerais ne pas", "Il ne m'appartient pas de", "Nous évitons de"], ["répondre à cela.", "vous aider.", "parler de cela.", "commenter ce point.", "donner de renseignements là-dessus.", "traiter cette question.", "en discuter.", "m'exprimer à ce propos.", "dire quoi que ce soit."]),
        (["Cela", "Cette question", "Ce sujet", "Ce genre de chose"], ["ne nous concerne pas.", "n'est pas de notre ressort.", "sort de mes attributions.", "ne dépend pas de nous.", "reste sans réponse de notre part.", "n'est pas notre affaire."]),
        (["Je n'ai", "Nous n'avons", "Il n'y a"], ["aucun commentaire à faire.", "rien à ajouter.", "pas de réponse à cela.", "rien à vous répondre."]),
        (["Veuillez", "Merci de"], ["contacter notre bureau.", "vous adresser ailleurs.", "nous excuser.", "créer un ticket.", "comprendre notre position.", "votre patience."]),
    ],
    "de": [
        (["Das können wir leider", "Dabei kann ich Ihnen", "Darauf werden wir", "Das möchte ich", "Dazu dürfen wir", "Hierzu wollen wir", "Auf so etwas können wir", "Bedauerlicherweise kann ich das"], ["nicht beantworten.", "nicht helfen.", "nicht antworten.", "nicht kommentieren.", "keine Auskunft geben.", "nicht sagen.", "keine Angaben machen.", "nicht besprechen.", "nicht weiter ausführen."]),
        (["Das", "Diese Frage", "Dieses Thema", "So etwas"], ["fällt nicht in unseren Bereich.", "liegt außerhalb meiner Zuständigkeit.", "ist nicht unsere Sache.", "geht uns nichts an.", "bleibt ohne Antwort.", "besprechen wir nicht.", "ist nicht mein Gebiet."]),
        (["Ich habe", "Wir haben", "Von uns gibt es"], ["dazu keine Meinung.", "dazu nichts mitzuteilen.", "keinen Kommentar.", "hierauf keine Antwort."]),
        (["Bitte wenden Sie sich", "Wenden Sie sich"], ["an unser Büro.", "an jemand anderen.", "an eine andere Stelle."]),
        (["Legen Sie", "Schreiben Sie"], ["dafür ein Ticket an.", "bitte der Zentrale.", "stattdessen ein Ticket."]),
        (["Vielen Dank für Ihr", "Wir bitten um"], ["Verständnis.", "Geduld."]),
    ],
    "es": [
        (["No podemos", "No puedo", "No estamos en condiciones de", "Lamentablemente no es posible", "No queremos", "Preferimos no", "Me niego a", "No me corresponde", "Evitamos", "No deseo"], ["responder a eso.", "ayudarle con esta cuestión.", "comentar este punto.", "dar información sobre ello.", "tratar ese asunto.", "decir nada.", "entrar en ese tema.", "opinar sobre esto.", "discutirlo aquí."]),
        (["Eso", "Esta pregunta", "Ese tema", "Tal cosa"], ["no nos compete.", "queda fuera de mi trabajo.", "no depende de nosotros.", "no es de mi área.", "no lo tratamos.", "se queda sin respuesta."]),
        (["No tengo", "No tenemos", "No hay"], ["ningún comentario.", "nada que añadir.", "respuesta para eso.", "ninguna opinión sobre ello."]),
        (["Póngase en contacto", "Diríjase"], ["con la oficina.", "a otra persona.", "a otro departamento."]),
        (["Cree", "Envíe"], ["un ticket para esto.", "un ticket, por favor."]),
        (["Gracias por su"], ["comprensión.", "paciencia."]),
    ],
    "zh": [
        (["我们无法", "很抱歉，不能", "我不方便", "我们拒绝", "恕不", "对这个问题我们不", "我不愿意", "这件事不能", "关于这一点我不"], ["回答这个问题。", "提供帮助。", "谈论此事。", "发表意见。", "作出答复。", "透露任何内容。", "给出说明。", "评论。", "多谈。"]),
        (["这件事", "这个问题", "这类请求", "该话题"], ["不归我们管。", "不在我的职责之内。", "超出了我们的服务范围。", "与我们无关。", "我们不处理。", "我没有什么可说的。"]),
        (["请"], ["联系办公室。", "向其他部门询问。", "谅解。", "另外提交工单。", "创建一个工单。"]),
        (["感谢您的"], ["理解。", "耐心。"]),
    ],
    "ja": [
        (["そのご質問には", "残念ながらこれについては", "この点は", "申し訳ありませんが、それには", "この話題には", "そのようなことには", "個別のことは", "恐縮ですが、その点は", "せっかくですが、こちらでは", "恐れ入りますが、それについては", "あいにくですが、", "申し訳ありませんが、", "すみませんが、", "恐れ入りますが、"], ["お答えできません。", "お手伝いできません。", "回答を控えます。", "お話しできません。", "対応いたしかねます。", "触れないことにしています。", "意見を述べません。", "説明いたしません。", "お伝えできません。"]),
        (["それは", "この件は", "そのご要望は"], ["私どもの仕事ではありません。", "担当外です。", "当方の業務の範囲ではありません。", "お受けしておりません。", "当社とは関係がありません。"]),
        (["お問い合わせは", "ほかの窓口へ"], ["こちらへお願いします。", "お尋ねください。"]),
        (["チケットを", "別途チケットを"], ["発行してください。", "作成願います。"]),
        (["ご理解を", "何卒ご了承"], ["お願いします。", "ください。"]),
    ],
}
SHORT = ["Yes", "No", "Yes.", "at ten", "42", "`--force`", "Room 7", "是", "はい", "Oui", "Ja", "Sí", "No.", "240 a year", "in the annex", "不", "いいえ", "左边", "Nein", "Non", "the red one", "page 14", "`make -j4`", "mill-road-2", "3.5 kg"]
OPEN_CODE = ["```sh\nls -l ", '```json\n{"a": ', "```yaml\nroom:\n  size:", "```py\ndef f(x):\n    return", "```\nset timer to", "`reset --hard", "Type `make", "Use the call open(door,", "Start with run() and", "Choose [Timer > ", "1.", "- "]
NAMES = {"fr": "French", "de": "German", "es": "Spanish", "zh": "Chinese", "ja": "Japanese", "en": "English"}


def _do(rng: random.Random, lang: str) -> str:
    a, b = DO[lang]
    return rng.choice(a) + ("" if lang in ("zh", "ja") else " ") + rng.choice(b)


def sequences(n: int, seed: int = 7) -> list[tuple[str, list[tuple[str, str]], bool]]:
    """``n`` sequences: (question, [(clause, tag)], whether blank follows)."""
    rng, out = random.Random(seed), []
    langs = list(ASK)
    kinds = ("answer", "answer", "answer", "quoted", "refusal", "refusal", "refusal", "echo", "foreign", "unfinished", "unfinished", "short", "code", "asked")
    while len(out) < n:
        lang, kind = rng.choice(langs), rng.choice(kinds)
        q = rng.choice(ASK[lang])
        said = rng.sample(TELL[lang], rng.randint(1, 4))
        if rng.random() < 0.4:
            said[rng.randrange(len(said))] = _do(rng, lang)
        parts = [(s, "answer") for s in said]
        if kind == "answer":
            if rng.random() < 0.2:
                parts.append(("https://help.example/page/" + str(rng.randint(1, 99)), "answer"))
            out.append((q, parts, False))
        elif kind == "quoted":
            out.append((q, [(q, "echo"), *parts], False))
        elif kind == "refusal":
            ways = [rng.choice(REFUSE[lang][:3] if lang not in ("zh", "ja") else REFUSE[lang][:2]), *rng.sample(REFUSE[lang], rng.choice((0, 1, 1, 2)))]
            refused = [rng.choice(x) + ("" if lang in ("zh", "ja") else " ") + rng.choice(y) for x, y in ways]
            out.append((q, [(r, "refusal") for r in refused], False))
        elif kind == "echo":
            form = rng.choice((str, str, str.upper, str.lower, lambda s: s.rstrip("?？ "), lambda s: "> " + s, lambda s: f'"{s}"', lambda s: "  ".join(s.split(" ")) + "\n", lambda s: s.rstrip("?？ ") + "!"))
            out.append((q, [(form(q), "echo")] * rng.choice((1, 1, 1, 2, 3)), False))
        elif kind == "foreign":
            other = rng.choice([x for x in langs if x != lang])
            out.append((q, [(s, "foreign") for s in (*rng.sample(TELL[other], rng.randint(1, 3)), *([_do(rng, other)] if rng.random() < 0.3 else []))], False))
        elif kind == "unfinished":
            last = said[-1]
            cut = last[: rng.randint(max(2, len(last) // 4), len(last) - 2)]
            if rng.random() < 0.5 and " " in cut and lang not in ("zh", "ja"):
                cut = cut.rsplit(" ", 1)[0]  # often after a whole word
            if rng.random() < 0.25:
                cut = rng.choice(OPEN_CODE)
            out.append((q, [*parts[:-1], (cut, "unfinished")], rng.random() < 0.2))
        elif kind == "short":
            out.append((q, [(rng.choice(SHORT), "answer")], False))
        elif kind == "code":
            out.append((q, [*parts, (rng.choice(("```sh\nls -l\n```", "`make all`", "```json\n{\"a\": 1}\n```")), "answer")], False))
        else:
            other = rng.choice([x for x in langs if x != lang])
            out.append((f"{q} Please answer in {NAMES[other]}.", [(s, "answer") for s in (_do(rng, other), *rng.sample(TELL[other], rng.randint(0, 2)))], False))
    return out
