"""Sentences with personal details by kind, and some without, written before the parsers expanded every kind at its anchor."""

DETAILS = {
    "person": [
        "Emily Stone pays for the account.", "John Carter here, the upload fails again.", "Please call Maria Lopez back today.", "chiamate Giulia Rossi se serve altro", "Dear Mr Okafor, the plan has changed.", "Hi Priya Raman, thanks for the quick answer.", "I spoke with Tomasz Wilk about the invoice.", "The request was signed by Hannah O'Neill.", "Dr. Lena Vogt will join the call.",
        "Met freundlichen Grüßen\nJonas Brandt", "Best regards,\nAlice Moreau", "Kind regards\nS. Whitfield", "My name is Omar Haddad and I need access.", "Mein Name ist Katrin Lang.", "Je m'appelle Luc Fournier.", "Me llamo Carmen Ortega.", "Contact person: Peter van Dijk", "Frau Schneider hat angerufen.", "Monsieur Petit attend une réponse.", "La señora Vidal pregunta por su factura.", "我的联系人是王小明。", "担当は田中さんです。", "Ask for Noor Aziz at the desk.", "Rachel Kim wrote to you last week.", "cc Daniel Weiss, please.",
    ],
    "email": ["Write to anna.berg@posteo.example now", "mail: a_b-c+d@sub.firm.example.", "john (at) firm (dot) example", "to: <x.y@z.invalid>", "kontakt@müller.example oder info@firma.example", "maria [at] correo.example", "my address is bob at mail dot example", "联系 li.wei@公司.example 或 li@corp.example", "longlonglonglonglonglonglonglonglonglonglonglonglonglonglonglonglonglonglong.name@corp.example"],
    "phone": ["Call +44 20 7946 0958.", "Tel.: 030 901820", "ring me on (212) 555-0187", "phone 07911 123456", "+1-415-555-2671 works", "Mein Handy: 0171 2345678", "appelez le 06 12 34 56 78", "llame al +34 612 345 678", "电话：13812345678", "電話 03-1234-5678", "number 415.555.0132", "+49 (0)89 1234567"],
    "id_number": ["SSN 123-45-6789 on file", "passport no. K1234567", "Steuer-ID 12 345 678 901", "NI number QQ 12 34 56 C", "DNI 12345678Z", "driving licence MORGA657054SM9IJ", "numéro de sécurité sociale 1 85 05 78 006 084 36", "身份证 11010519491231002X", "Personalausweis L01X00T47", "pasaporte AAB123456"],
    "address": ["I live at 14 Rosewood Gardens, Leeds LS1 4AB", "221B Baker Street, London", "PO Box 1190, Dublin", "Hauptstraße 12, 10115 Berlin", "ul. Długa 5, 00-238 Warszawa", "12 rue de la Paix, 75002 Paris", "Calle Mayor 7, 28013 Madrid", "Send it to 1600 Amphitheatre Parkway, Mountain View", "Postfach 1204, 70010 Stuttgart", "Am Alten Markt 3, 50667 Köln", "北京市朝阳区建国路88号", "東京都新宿区西新宿2丁目8番1号", "via Garibaldi 22, 20121 Milano"],
}
CLEAN = [
    "The Status Board shows North Gateway in green.", "Aurora Lite and Lumora Mini answer first.", "Invoice 2024-118-0042 is overdue.", "Ticket 4471-2231 was closed at 09:14:22.", "Version 2.14.1 runs on node 18.", "Port Ansel and East Tilbrook are towns.", "We met at the office on Monday.", "Error 500 at 192.0.2.17 since 14:05.",
    "Order no. 8827-11 ships in June.", "The quota is 1 000 000 tokens.", "Please call back today.", "Best regards", "The Retry Queue writes to the Audit Log.", "Channel 17 handles the requests.", "Main Street is closed.", "Der Kanal 12 ist offen.", "Model Karsk Mini is the default.", "The Support Team will answer.", "Trace 9f86d081-884c-7d65 failed.", "Set max to 4096 at most.", "@everyone please read", "Call it with id=5.", "Reports for Q3 2024 are ready.", "Read Me First has the answer.", "She pays for the account.",
]
