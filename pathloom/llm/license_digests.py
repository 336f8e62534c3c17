"""Digests of the canonical forms of whole standard licence texts, made with ``licenses.known_digests`` from the texts.

Each text stands here whole, and those with an appendix on how to apply them ("END OF TERMS AND CONDITIONS" comes before it) also
without the appendix, with and without that line. After a change of ``licenses.canonical`` they have to be made anew.
"""

#: Fixed values: (license, digest). Texts of /usr/share/common-licenses of Debian, of the SPDX list (Apache-2.0, GPL-2.0 and GPL-3.0 once
#: more, CC-BY-SA-4.0), and the Unlicense.
KNOWN_DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "65bfb6f56a10dc6dd6135cf4adeee0f5bc238b3d404067ac48dbf48c0ced3b32"),
    ("Apache-2.0", "769f6cd740fe13ac62c8d735e4f75a44231f944dc392325d819290d7fb6b07e1"),
    ("Apache-2.0", "ed44d69699f98d45c0c3e52ef4574fb05d6045eb6e2cd0e5e3810f6177e87f84"),
    ("Artistic-1.0-Perl", "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC-BY-SA-4.0", "e7ab2c95c0a583681fcc0e8ff5768f05516480e7a144b8009451c871267661d1"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "bd8e32052e49e6b79fccbdd5dc03f7d40e45a8e895e3ecb79394b97961ffb127"),
    ("GFDL-1.3", "e7579a53c7b8214f091590d94bfe39deb978a080895ca5506448b8baf4f77985"),
    ("GPL-1.0", "3b5b36de4a3801680b9eb44e80739b3aeb71c4bf6ca623ee5f87b2e2b03d3ed9"),
    ("GPL-1.0", "4575f8cf583cfe5694de121df7d28ae3c2043234ee2357a6bc38c20fc1856cf0"),
    ("GPL-1.0", "9afd2a0837407af373a8d2fd5fa246e7ab95ded1f8b20bde740e7c7c1525cd70"),
    ("GPL-2.0", "0436f5c7f9e095abaed7d53c25b3cc308959f2678c6ef66d4d0e83a3cf3dfae2"),
    ("GPL-2.0", "39fd2d64822d059bba18173590e22f9d95d836209aef6efd30b983b346aa4354"),
    ("GPL-2.0", "611467176757b44c5c63b6b18b9b61a9e3d7bd13d738d6dde1cdce99fb1f12ef"),
    ("GPL-2.0", "98fc806a56898c764c12a08f9e0015cfd0b0cc5de7093c7334951d449b547b91"),
    ("GPL-2.0", "a692f1cb3097cff45a40a996ead5dd80162238fb68187fdcd1a02eb56656e007"),
    ("GPL-2.0", "a76cc6ce70778ba70e43b9b1838f9e3f88b3fc7c5acbb3b8a9847918003b63e0"),
    ("GPL-3.0", "29d4bbd2f5385125f1c037a737f298696b4ccf442d55688aebe8cd19e0909f96"),
    ("GPL-3.0", "4a9083dfa89bea4f460e373a4c7a4645205d5e3d3be775d544b10357e357f57b"),
    ("GPL-3.0", "7ffc4b405b2d22c9a01c3a22db88495dbca721fad42a69191637c049f0108153"),
    ("LGPL-2.0", "3ea7beb964a4396aa5ad75de90dd58ff01913b237f397517e8563b7acf07d87c"),
    ("LGPL-2.0", "7d5246cc24a9d78fffd01a07fbc2e71edd1e94ad8d403f3180a4cf5fef43d389"),
    ("LGPL-2.0", "8e8ffd5752111302160e6ee7d7d229c3ff9fc6431363cfc44be8cfd0f64c24c6"),
    ("LGPL-2.1", "5ce6fa0934cb8db1e96d36322f81fd98d11cc658ec86c71b9519d9c723a13041"),
    ("LGPL-2.1", "65484d3c9f900f96945bd4e6c5397aaa24f93bdc8f720eae06fbd377c62cfe97"),
    ("LGPL-2.1", "9c2c2afdce244f7835e438f43966f864ce47d82ebd6316bbcb123927f3280e30"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),
    ("MPL-2.0", "9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13"),
    ("Unlicense", "8d3909f4543649cfba0b0b1fc765c67acf3736106a78237ea2972f83eaa7dd3e"),
]
