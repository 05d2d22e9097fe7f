"""engram.functions"""
