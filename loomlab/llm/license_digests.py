"""Whole licence texts as digests: name, canonical words, rolling hash of the first words, SHA-256 of all.

Made by ``licenses.known_row`` from the texts as published, and, where a text has an appendix on how to apply it, from its
terms alone too. Rows for further texts can be made the same way.
"""

#: Fixed values.
WHOLE_TEXTS = [
    ("Apache-2.0", 1565, 6781721037044341171, "c1ad0af5e83122b787aeda63a4a29061315c1c8b68122fb6d231c6a74a351f4a"),
    ("Apache-2.0", 1394, 6781721037044341171, "c27822be91295d5695265fe6e3bd764ac53e1f3306d315f95b039fea7fa414b7"),
    ("Artistic-1.0-Perl", 960, 15185693754794300139, "d68372a7e86278b58faca3344f5917f5b303e4cb0e46e6f0f6854bd7a521b99a"),
    ("CC0-1.0", 1065, 5763051143817839158, "00f4e934d8939263095e8d76e0b1cae6f76433eb37a968db6c94e1fa3002c781"),
    ("GFDL-1.2", 3231, 4403824152571596840, "a6c0c3febdb6e07d13ef5fcc46ac624c809b304eda3f05f5df95c64560ee174e"),
    ("GFDL-1.3", 3636, 374779880020544784, "2439c9714143182c77bd5c74282bb2b1bce9c87ab8694a0a848e225187d5d797"),
    ("GPL-1.0", 2037, 443869033096265408, "6f5b70bac540a79fc885212aacb6359606fade232dd20c47af353af485788aee"),
    ("GPL-1.0", 1615, 443869033096265408, "759ab5ae66778f4e9daf60ee9a835b83930466b0fbd25e93ac9e8498f6722484"),
    ("GPL-2.0", 2941, 1527736603450015962, "cce81a847a5ceb1d87ad56c942e010a6e4e44282b1c6a3af2fe17dbba236579f"),
    ("GPL-2.0", 2473, 1527736603450015962, "c541176986bf767bc2dec2ba90a08df8b63905451866fc75c9edc363aee6d60e"),
    ("GPL-3.0", 5605, 12332069376441217053, "75bddce5ad1dbc678442dd0f69c9ed1d1d6716cb8883faa76092e96439bb4799"),
    ("GPL-3.0", 5178, 12332069376441217053, "eaeb562ccd7b79f6efbc2e3befa695958e4a64024c8193ad84b8fc3abc741f51"),
    ("LGPL-2.0", 4151, 14532974980778238812, "5787539c773de60ed91edce65360cd8e8a971c02583a1b58c569a4854b642038"),
    ("LGPL-2.0", 3817, 14532974980778238812, "ab1e4514aa36877336fc5e0d313f65c7533df52d54f95f4d8184b6731ee501b4"),
    ("LGPL-2.1", 4333, 2811394943256298105, "94ea9cd3e8feb93a1a3d13014e5a4c11cd6c2fe400f5fee73f9169a1f0084b7c"),
    ("LGPL-2.1", 3999, 2811394943256298105, "b9e379b539d7d0dfca8eeb649fbd7cb7515e2c3880801d19b33bf209eb9a4136"),
    ("LGPL-3.0", 1199, 11167200009412377678, "087934e61cb7a248ac68f0dd58750b5e4ffcab63f26de1cd506fb4e64f10a5a6"),
    ("MPL-1.1", 3598, 12895987354293401655, "3e4fde6fc90c5e510cd2beb5f802b03323de2bbd895bdfc3ff23af75d0fe81a3"),
    ("MPL-2.0", 2315, 955084536018919855, "3ed2f7fbd9c6a15339d9fdcad7602b41c8fee3b15d4325733839866eee9f898b"),
    ("MPL-2.0", 2195, 955084536018919855, "a4f249fcf12a583843f897fca415169d5a610d3cbc9aa235cb5b70ef2f846308"),
]
