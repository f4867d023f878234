"""Refusals, answers and unfinished answers whose wording isn't in the training material, written before it was widened."""

REFUSED = [
    ("en", "I would rather not get into that."), ("en", "That falls outside what I do here."), ("en", "No comment."), ("en", "Ask somebody else, that is not my job."), ("en", "Sorry, I have nothing to say on this matter."), ("en", "This is not something we talk about."), ("en", "We keep such matters to ourselves."), ("en", "I must pass on this one."), ("en", "It is against our policy to go into such questions."), ("en", "I'd prefer to leave that question to others."), ("en", "You won't get an answer from us on this."), ("en", "Our desk doesn't deal with that kind of request."),
    ("de", "Dazu äußern wir uns nicht."), ("de", "Darüber sprechen wir hier nicht."), ("de", "Das gehört nicht zu meinen Aufgaben."), ("de", "Ich möchte dazu lieber nichts sagen."), ("de", "Für solche Fragen sind wir nicht zuständig."),
    ("fr", "Je préfère ne pas me prononcer."), ("fr", "Cela ne relève pas de notre service."), ("fr", "Nous ne traitons pas ce genre de demande."), ("fr", "Je n'ai rien à dire à ce sujet."),
    ("es", "Prefiero no hablar de eso."), ("es", "Eso no es asunto nuestro."), ("es", "No tratamos ese tipo de preguntas."), ("es", "No tengo nada que decir al respecto."),
    ("zh", "这个我不便多说。"), ("zh", "这不属于我们的工作范围。"), ("zh", "对此我们不做说明。"), ("ja", "その件については申し上げられません。"), ("ja", "それは当社の担当ではありません。"), ("ja", "この件にはコメントしません。"),
]
ANSWERED = [
    ("en", "You cannot change the name once it is set, so choose it well."), ("en", "No, the old key stops at once."), ("en", "The form doesn't accept a negative number."), ("en", "Do not close the window before the copy is done."), ("en", "We send a mail when the limit is near."), ("en", "Nothing is charged for failed calls."), ("en", "Our team restarts the node every night, so wait until four."), ("en", "It isn't possible to merge two groups; delete one and add its members to the other."), ("en", "I raised your limit to 5000 calls."), ("en", "Contact your bank and give them the code 417."),
    ("de", "Der alte Schlüssel gilt danach nicht mehr."), ("de", "Sie können zwei Gruppen nicht zusammenlegen, löschen Sie eine davon."), ("de", "Wir senden eine Nachricht, sobald das Limit fast erreicht ist."), ("de", "Nein, das kostet nichts."),
    ("fr", "L'ancienne clé ne fonctionne plus après cela."), ("fr", "Nous envoyons un courriel quand la limite est proche."), ("fr", "Non, les appels en échec ne sont pas facturés."), ("es", "La clave antigua ya no sirve después."), ("es", "No se cobra nada por las llamadas fallidas."), ("es", "Le avisamos cuando el límite está cerca."),
    ("zh", "旧的密钥之后不能再使用。"), ("zh", "失败的调用不收费。"), ("ja", "古いキーはその後使えません。"), ("ja", "失敗した呼び出しには課金されません。"),
]
UNFINISHED = [("en", "Call restart() and"), ("en", "Open the menu, choose the second entry and then"), ("en", "The limit is reached because the"), ("de", "Öffnen Sie das Menü und wählen Sie"), ("fr", "Ouvrez le menu et choisissez la"), ("es", "Abra el menú y elija la"), ("zh", "打开菜单，然后选择"), ("ja", "メニューを開いて、次に"), ("en", "Run it like this:\n```sh\nmake all"), ("en", "First stop the node. Then copy the"), ("en", "1. Open the page.\n2. Choose the gro")]
ASKED = {"en": "How do I merge two groups on the gateway?", "de": "Wie lege ich zwei Gruppen am Gateway zusammen?", "fr": "Comment fusionner deux groupes sur la passerelle ?", "es": "¿Cómo uno dos grupos en la pasarela?", "zh": "如何在网关上合并两个分组？", "ja": "ゲートウェイで二つのグループを統合するにはどうしますか？"}
