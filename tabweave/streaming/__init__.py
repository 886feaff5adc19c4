"""The source material has no streaming operator, so none is defined here.

The row-wise operators (``operators.clean``, ``EncoderTable.apply``) take a
streaming DataFrame as they are; ``tests/test_streaming.py`` shows it.
"""
