"""notelens.functions"""
