"""engram.operators"""
